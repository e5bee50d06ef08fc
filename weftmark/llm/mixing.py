"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

A source's documents are dealt, in hashed order, into blocks. Source s with integer weight a_s
out of A has, for its block j, the release time floor(j A / a_s) and the deadline
ceil((j + 1) A / a_s); in each slot the released block with the earliest deadline goes out. On
one channel that keeps every source within less than one block of its target share at every
slot. After A slots all sources are square again, so the schedule repeats: the driver works out
one period (bounded by the weights alone), and blocks find their slot by arithmetic and a
broadcast of that period. When a source has fewer blocks left than a period takes, one shorter
period takes what it has, and the rest go on without it; no document is dropped.

A document's rank in its source comes from counts of (source, hash bucket), running sums over
buckets and row numbers inside them, so a hot source is spread over many tasks.

Defined results: null and unlisted sources share the ``other`` weight; equal ids get places in
the order of a hash of their rows (maps by their text); null ids sort by that hash too; texts are only hashed, whatever their
length; clashing column names are told apart by a prefix; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftmark.llm.common import shuffle_width

#: Parts of the production mix; together with OTHER they make one period.
WEIGHTS: dict[str, int] = {"src0": 20, **{f"src{k}": 10 for k in range(1, 5)}, **{f"src{k}": 4 for k in range(5, 10)}, **{f"src{k}": 2 for k in range(10, 20)}}
OTHER = 1
OTHER_NAME = "(other)"
#: Slots of a period of the production mix, and documents of a block.
PERIOD, BLOCK = sum(WEIGHTS.values()) + OTHER, 64
#: Most slots of a period and most weighted sources: what the driver plans and broadcasts is bounded by them.
MAX_PERIOD, MAX_SOURCES = 1_000, 100


def edf_period(weights: Mapping[str, int]) -> list[str]:
    """The source of each slot of one period, earliest deadline first among released blocks; ties by name."""
    period = sum(weights.values())
    release: dict[int, list[tuple[int, str]]] = {}
    for s, a in weights.items():
        for j in range(a):
            release.setdefault(j * period // a, []).append((-(-(j + 1) * period // a), s))
    ready: list[tuple[int, str]] = []
    out = []
    for t in range(period):
        for job in release.get(t, ()):
            heapq.heappush(ready, job)
        out.append(heapq.heappop(ready)[1])
    return out


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[tuple[dict[str, int], int]]:
    """(blocks of each source in a period, how many periods), until every source is used up."""
    left = {s: n for s, n in blocks.items() if n}
    out: list[tuple[dict[str, int], int]] = []
    while left:
        times = min(n // weights[s] for s, n in left.items())
        if times:
            out.append(({s: weights[s] for s in left}, times))
        last = {s: min(n - times * weights[s], weights[s]) for s, n in left.items()}
        last = {s: n for s, n in last.items() if n}
        if last:
            out.append((last, 1))
        left = {s: n - times * weights[s] - last.get(s, 0) for s, n in left.items()}
        left = {s: n for s, n in left.items() if n}
    return out


def slot_rows(blocks: Mapping[str, int], weights: Mapping[str, int]) -> tuple[list[dict], list[dict]]:
    """The phases (source, phase, block numbers from lo to below hi, a of them a period) and the slots of their periods."""
    spans, slots, base = [], [], 0
    first = dict.fromkeys(blocks, 0)
    for k, (parts, times) in enumerate(phases(blocks, weights)):
        period, nth = sum(parts.values()), dict.fromkeys(parts, 0)
        for s, n in parts.items():
            spans.append({"s": s, "k": k, "lo": first[s], "hi": first[s] + n * times, "a": n, "period": period})
            first[s] += n * times
        for slot, s in enumerate(edf_period(parts)):
            slots.append({"s": s, "k": k, "j": nth[s], "base": base + slot})
            nth[s] += 1
        base += period * times
    return spans, slots


def _rows(spark: SparkSession, rows: list[dict], schema: str, prefix: str) -> DataFrame:
    """A few rows as a literal in the plan, columns prefixed."""
    literal = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))
    return literal.toDF(*[prefix + c for c in literal.columns])


def mix(
    df: DataFrame,
    weights: Mapping[str, int] = WEIGHTS,
    other: int = OTHER,
    block_size: int = BLOCK,
    id_col: str = "doc_id",
    source_col: str = "source",
) -> tuple[DataFrame, str]:
    """``df`` with source, block, slot and place under a prefix that none of its columns has, and that prefix.
    Sorted by slot and place it is the mix."""
    prefix = "_mix_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    weights = {**weights, OTHER_NAME: other}
    if min(weights.values()) < 1 or sum(weights.values()) > MAX_PERIOD or len(weights) > MAX_SOURCES:
        raise ValueError("weights are whole numbers from 1, with a bounded sum and number of sources")
    spark = df.sparkSession
    named = F.col(source_col).cast("string").isin([s for s in weights if s != OTHER_NAME])
    key = F.when(named, F.col(source_col).cast("string")).otherwise(F.lit(OTHER_NAME))
    rows = {r["s"]: r["n"] for r in df.groupBy(key.alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each weight
    spans, slots = slot_rows({s: -(-n // block_size) for s, n in rows.items()}, weights)
    buckets = max(shuffle_width(spark), min(1 << 16, sum(rows.values()) // 4096))
    p = prefix
    tie = F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields])
    keyed = df.withColumns({f"{p}source": key, f"{p}h": F.xxhash64(F.coalesce(F.col(id_col).cast("long"), tie), F.lit(17)), f"{p}tie": tie})
    keyed = keyed.withColumn(f"{p}bucket", F.pmod(F.shiftright(f"{p}h", 8), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy(f"{p}source", f"{p}bucket").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(f"{p}source").orderBy(f"{p}bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(f"{p}source", f"{p}bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(f"{p}before"))
    inside = Window.partitionBy(f"{p}source", f"{p}bucket").orderBy(f"{p}h", F.col(id_col), f"{p}tie")
    ranked = keyed.join(starts, [f"{p}source", f"{p}bucket"]).withColumn(f"{p}rank", F.col(f"{p}before") + F.row_number().over(inside) - 1)
    blocked = ranked.withColumns({f"{p}block": F.floor(F.col(f"{p}rank") / block_size), f"{p}place": (F.col(f"{p}rank") % block_size).cast("int")})
    # both are bounded by the weights, not the data: at most 2 * MAX_SOURCES phases of at most MAX_PERIOD slots, a few MB
    spans = F.broadcast(_rows(spark, spans, "s:string,k:int,lo:long,hi:long,a:long,period:long", p))
    slots = F.broadcast(_rows(spark, slots, "s:string,k:int,j:long,base:long", p).withColumnsRenamed({f"{p}s": f"{p}s2", f"{p}k": f"{p}k2"}))
    c = lambda name: F.col(p + name)
    phased = blocked.join(spans, (c("source") == c("s")) & (c("block") >= c("lo")) & (c("block") < c("hi")))
    placed = phased.join(slots, (c("s") == c("s2")) & (c("k") == c("k2")) & ((c("block") - c("lo")) % c("a") == c("j")))
    slot = c("base") + F.floor((c("block") - c("lo")) / c("a")) * c("period")
    return placed.select(*df.columns, c("source"), c("block"), slot.alias(f"{p}slot"), c("place")), p


def mix_plan(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """doc_id, source (as weighted), block, slot and place of every row; the texts are not read."""
    out, p = mix(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("from")), source_col="from", **options)
    return out.select("doc_id", *[F.col(p + c).alias(c) for c in ("source", "block", "slot", "place")])


def in_mix_order(df: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """All rows and columns of ``df``, range-partitioned and sorted in mix order."""
    mixed, p = mix(df, id_col=id_col, source_col=source_col, **options)
    return mixed.orderBy(f"{p}slot", f"{p}place").select(*df.columns)
