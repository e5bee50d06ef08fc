"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample (``sample`` rows with the smallest hashed ids) and
broadcast; every vector is then indexed, one leaf in each tree. For largest inner products the
trees see vectors with one more component that brings all of them to the same norm (0 for
queries). A query walks all trees through one priority queue ordered by the least margin on the
path and takes ``probes`` leaves. Queries meet candidates leaf by leaf: leaves with many members
or queries are cut into blocks, and each task returns only its best ``k`` a query, and of those none
below a floor: the ``k``-th best that the sampled rows in the query's own leaves give. Scores are
exact inner products of the original vectors in double precision.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, null
ids, and vectors of another length than the most frequent one (the longest of those in a tie)
take no part; a query never meets rows with its own id; repeated (id, vector) rows count once,
an id with several vectors by its best; ties go to the smaller id; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftmark.llm.common import Scratch, map_rows, shuffle_width
from weftmark.llm.forest import build, leaves_of, search

SCHEMA = "query_id long, rank int, vec_id long, score double"
#: Members and queries of a leaf that meet in one task at most; rows for a task.
MEMBERS, QUERIES, TASK_ROWS = 20_000, 4_000, 40_000


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _widened(x: np.ndarray, norm2: float) -> np.ndarray:
    """One more component, so that all rows have the same norm."""
    return np.hstack([x, np.sqrt(np.maximum(norm2 - (x**2).sum(1), 0.0))[:, None]])


def nearest(
    df: DataFrame,
    k: int = 20,
    every: int = 20,
    trees: int = 8,
    leaf: int = 200,
    sample: int = 20_000,
    probes: int = 112,
    seed: int = 11,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """The ``k`` nearest rows found for each row whose id is divisible by ``every``."""
    spark = df.sparkSession
    single = isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    kind = "<f4" if single else "<f8"
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    scratch = Scratch(spark, "ann")
    rows = scratch.write(rows.dropDuplicates(["id", "v"]), "rows")  # read several times below
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    rows = rows.where(F.size("v") == common["d"])
    norm2 = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()[0]
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()  # at most ``sample`` vectors
    drawn = np.array([r["id"] for r in picked])
    picked = _widened(np.array([r["v"] for r in picked]), norm2)
    draw = np.random.default_rng(seed)
    grown = [build(picked, leaf, draw) for _ in range(trees)]
    forest = spark.sparkContext.broadcast((grown, drawn, picked[:, :-1]))  # bounded by the sample

    def start():
        held, sample_ids, sample_rows = forest.value
        wide = _widened(sample_rows, norm2)
        members: dict[int, np.ndarray] = {}
        for j, t in enumerate(held):
            home = leaves_of(t, wide)
            order = np.argsort(home, kind="stable")
            cuts = np.searchsorted(home[order], np.arange(t.leaves + 1))
            members |= {a * trees + j: order[cuts[a] : cuts[a + 1]] for a in range(t.leaves)}

        def ask(i: int, q: np.ndarray) -> tuple[list[int], float]:
            """The leaves to visit, and a floor: the k-th best score among the sampled rows in those leaves."""
            leaves = [a * trees + j for j, a in search(held, q, probes)]
            near = np.zeros(len(sample_ids), bool)
            for x in leaves:
                near[members[x]] = True
            near &= sample_ids != i
            ids = sample_ids[near]
            if len(np.unique(ids)) < k:
                return leaves, -np.inf
            score = sample_rows[near] @ q[:-1]
            if len(ids) != len(np.unique(ids)):  # an id counts once
                order = np.lexsort((-score, ids))
                score = score[order][np.append(True, np.diff(ids[order]) != 0)]
            floor = float(np.partition(score, -k)[-k])
            return leaves, floor - 1e-9 * (1 + abs(floor))

        def step(cols):
            ids, x = cols[0], np.array(cols[1])
            homes = np.stack([leaves_of(t, _widened(x, norm2)) * trees + j for j, t in enumerate(held)], 1).tolist()
            flat = np.hstack([x, np.zeros((len(x), 1))])
            return [(i, v.astype(kind).tobytes(), home, *(ask(i, q) if i % every == 0 else ([], None))) for i, v, home, q in zip(ids, x, homes, flat)]

        return step

    index = scratch.write(map_rows(rows, "id long, vector binary, homes array<int>, visits array<int>, floor double", start), "index")
    entries = index.select("id", "vector", F.explode("homes").alias("leaf"), F.lit(False).alias("query"), F.lit(None).cast("double").alias("floor"))
    asks = index.select("id", "vector", F.explode("visits").alias("leaf"), F.lit(True).alias("query"), "floor")
    both = entries.unionByName(asks)
    # one row a leaf of the forest: bounded by the sample
    counts = both.groupBy("leaf").agg(F.count_if(~F.col("query")).alias("m"), F.count_if("query").alias("q")).collect()
    total = sum(r["m"] + r["q"] for r in counts)
    large = [(r["leaf"], -(-r["m"] // MEMBERS), -(-r["q"] // QUERIES)) for r in counts if r["m"] > MEMBERS or r["q"] > QUERIES]
    parts = F.lit(1), F.lit(1)
    if large:
        m_of = F.create_map(*[F.lit(x) for a, m, _ in large for x in (a, m)])
        q_of = F.create_map(*[F.lit(x) for a, _, q in large for x in (a, max(q, 1))])
        parts = F.coalesce(F.try_element_at(m_of, F.col("leaf")), F.lit(1)), F.coalesce(F.try_element_at(q_of, F.col("leaf")), F.lit(1))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("query"), parts[1]).otherwise(parts[0])).cast("int")
    across = F.sequence(F.lit(0), F.when(F.col("query"), parts[0]).otherwise(parts[1]) - 1)
    dealt = both.withColumn("mine", mine).withColumn("other", F.explode(across))
    cell = F.xxhash64("leaf", F.when(F.col("query"), F.col("mine")).otherwise(F.col("other")), F.when(F.col("query"), F.col("other")).otherwise(F.col("mine")))
    buckets = max(shuffle_width(spark), -(-total // TASK_ROWS))
    dealt = dealt.select(cell.alias("cell"), F.pmod(F.xxhash64(cell), F.lit(buckets)).alias("bucket"), "query", "id", "vector", "floor")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _, group in pdf.groupby("cell", sort=True):
            is_query = group["query"].to_numpy()
            ids = group["id"].to_numpy()
            x = np.frombuffer(b"".join(group["vector"]), kind).reshape(len(group), -1).astype(np.float64)
            q_ids, q, c_ids, c = ids[is_query], x[is_query], ids[~is_query], x[~is_query]
            floor = group["floor"].to_numpy(np.float64)[is_query]
            if not len(q) or not len(c):
                continue
            for at in range(0, len(q), 256):
                found.append(_best(q_ids[at : at + 256], q[at : at + 256], floor[at : at + 256], c_ids, c, k))
        if not found:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        a, b, s = (np.concatenate(z) for z in zip(*found))
        order = np.lexsort((b, -s, a))  # an id that several trees gave, or that holds several vectors, stays with its best score
        a, b, s = a[order], b[order], s[order]
        once = np.sort(np.unique(np.stack([a, b]), axis=1, return_index=True)[1])
        a, b, s = a[once], b[once], s[once]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
        return pd.DataFrame({"query_id": a[rank < k], "vec_id": b[rank < k], "score": s[rank < k]})

    close = dealt.groupBy("bucket").applyInPandas(meet, "query_id long, vec_id long, score double")
    once = close.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _best(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k best (query, candidate, score) from the floor on, ties to smaller ids, each candidate id by its best row.
    A fast product picks, with slack; one sum in fixed order scores."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    first = np.flatnonzero(np.append(True, c_ids[1:] != c_ids[:-1]))
    rough = q @ c.T
    rough[q_ids[:, None] == c_ids[None, :]] = -np.inf
    best = np.maximum.reduceat(rough, first, axis=1) if len(first) < len(c_ids) else rough  # an id counts once towards the bar
    keep = min(k, best.shape[1])
    bar = np.maximum(np.partition(best, -keep, axis=1)[:, -keep], floor)
    if best is not rough:  # of an id's rows only those that may be its best
        bar = np.maximum(bar[:, None], np.repeat(best, np.diff(np.append(first, len(c_ids))), axis=1))
    else:
        bar = bar[:, None]
    slack = 1e-9 * (1 + np.abs(np.where(np.isfinite(bar), bar, 0)))
    i, j = np.nonzero((rough >= bar - slack) & np.isfinite(rough))
    score = np.einsum("ij,ij->i", q[i], c[j])
    order = np.lexsort((-score, c_ids[j], i))
    i, j, score = i[order], j[order], score[order]
    once = np.append(True, (i[1:] != i[:-1]) | (c_ids[j[1:]] != c_ids[j[:-1]]))[: len(i)]
    i, j, score = i[once], j[once], score[once]
    order = np.lexsort((c_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, int)
    rank = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i))))
    return q_ids[i[rank < k]], c_ids[j[rank < k]], score[rank < k]
