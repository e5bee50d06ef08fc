"""Near-duplicates by an exact n-gram Jaccard join: grouped prefix filtering, then connected components.

1. Every text becomes its set of hashed word shingles, named by a fingerprint (``sid``): exact copies cost nothing from here on.
2. Shingles are ordered globally by frequency, rarest first, ties by hash. Frequencies come from a counter array of fixed size
   over all texts; an order need only be the same everywhere to keep prefix filtering exact, so counters shared by several
   shingles do no harm.
3. Sets with identical prefixes and the same size are collapsed into one group (``gid``). A group sends each shingle of its
   prefix once, however many sets it holds; entries whose shingle no second group of a fitting size holds are dropped at once.
4. Group pairs that share a shingle are filtered by size and by parity bitmaps: the Hamming distance of two sets' bitmaps never
   exceeds their symmetric difference, and a group's bitmap leaves out the cells in which its members differ. Shingles with
   many holders are cut into blocks, compared block by block.
5. Surviving pairs are expanded to the groups' members, and a group's members are paired with each other in the same way; wide
   bitmaps drop most pairs, the rest are verified on the full sets.
   For components each group first tries its most promising partners; components of those links then make most of the other
   pairs needless, and every pair that may still join two components is verified. ``similar_sets`` verifies all pairs.
6. Components of the links, spread to the documents of each set.

Nothing but fixed-size arrays (the counters, bitmaps of wanted sets and documents) reaches the driver. Texts are read four
times, but from the third on only those that hold a set to be verified are cut into shingles.
Hashes and fingerprints have 64 bits; equal hashes of different shingles are taken as equal.

Defined results: null, empty and blank texts have the empty set and stand alone; a text with
fewer words than a shingle has one; texts of any length are read whole; rows with equal ids are documents of their own, and a
component's id is its smallest non-null document id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from weftmark.llm.common import Scratch, map_rows, salted_join, schema_of, shuffle_width
from weftmark.llm.components import components
from weftmark.llm.shingles import mix, set_id, shingles

#: Counters of the frequency order, and the slices in which they travel.
SKETCH_BITS, SLICES = 20, 64
#: Bits of the bitmaps that pick the sets and documents to verify, and words of a set's parity bitmap.
WANTED_BITS, PARITY_WORDS = 24, 16
#: Groups of one shingle that are compared in one block; prefix entries and pair rows for one task.
BLOCK, TASK_ENTRIES, TASK_ROWS = 512, 400_000, 30_000


def _add_up(parts: DataFrame, or_: bool, kind: str, total: int) -> np.ndarray:
    """Sum (or OR) fixed-size slices (slice int, data binary) of many tasks; each task that gathers them holds one array a slice."""
    out = schema_of("slice int, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(data.as_buffer(), kind)
                if k not in held:
                    held[k] = x.copy()
                elif or_:
                    held[k] |= x
                else:
                    held[k] += x
        if held:
            columns = [pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(out))

    rows = parts.repartition(min(SLICES, shuffle_width(parts.sparkSession)), "slice").mapInArrow(run, out).collect()  # one row a slice: fixed size
    whole = np.zeros(total, kind)
    size = total // SLICES
    for r in rows:
        whole[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["data"], kind)
    return whole


def parity(hashes: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of the bitmap's cells."""
    cells = np.bincount((hashes & np.uint64(PARITY_WORDS * 64 - 1)).astype(np.int64), minlength=PARITY_WORDS * 64)
    return np.packbits((cells & 1).astype(np.uint8)).tobytes()


def wide_parity(hashes: np.ndarray) -> bytes:
    """A parity bitmap of four cells a hash, rounded up to a power of two: what the fixed one is too small for."""
    bits = 1 << min(max((4 * len(hashes) - 1).bit_length(), 9), 16)
    cells = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_distance(x: bytes, y: bytes) -> int:
    """Hamming distance of two such bitmaps; the larger is folded to the smaller's size, which keeps it a parity bitmap."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    a, b = np.bitwise_xor.reduce(a.reshape(-1, n)), np.bitwise_xor.reduce(b.reshape(-1, n))
    return int(np.bitwise_count(a ^ b).sum())


def _scan(texts: DataFrame, width: int) -> DataFrame:
    """A row (doc_id, n, sid, parity, wide) for each document, and the task's frequency counters in slices."""
    out = schema_of("doc_id long, n long, sid long, parity binary, wide binary, slice int, data binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(out)
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        emit = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, width) for t in part.column(1).to_pylist()]
                every = np.concatenate([*sets, np.zeros(0, np.uint64)])
                counts += np.bincount((every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
                none = [None] * len(sets)
                yield emit(part.column(0), [len(s) for s in sets], [set_id(s) for s in sets], [parity(s) for s in sets], [wide_parity(s) for s in sets], none, none)
        size = len(counts) // SLICES
        none = [None] * SLICES
        yield emit(none, none, none, none, none, range(SLICES), [counts[k * size : (k + 1) * size].astype(np.int64).tobytes() for k in range(SLICES)])

    return texts.mapInArrow(run, out)


def prefix_length(n: int, pct: int) -> int:
    return n + (-pct * n) // 100 + 1


def group_id(prefix: np.ndarray, n: int) -> int:
    """A signed 64-bit fingerprint of a prefix (as a set) and a size."""
    return xxhash.xxh3_64_intdigest(np.sort(prefix).tobytes(), seed=n) - (1 << 63)


def _entries(texts: DataFrame, width: int, pct: int, counters, buckets: int, hot: int) -> DataFrame:
    """Packed by bucket, kind 0: prefix entries of every group (group count, then per group gid, size, entries, then the shingles);
    kind 1: which sets a group holds (gid, sid). Shingles that more than ``hot`` groups may hold are dealt to several buckets by group."""

    def start():
        counts = counters.value
        seen: set[int] = set()

        def step(cols):
            tokens, gids, sizes, ks, members = [], [], [], [], []
            for text in cols[0]:
                s = shingles(text, width)
                if not len(s) or (sid := set_id(s)) in seen:
                    continue
                if len(seen) > 2_000_000:  # what is sent twice counts once
                    seen.clear()
                seen.add(sid)
                k = prefix_length(len(s), pct)
                often = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                prefix = s[np.lexsort((s, often))[:k]] if k < len(s) else s
                gid = group_id(prefix, len(s))
                members.append((gid, sid))
                if gid in seen:
                    continue
                seen.add(gid)
                tokens.append(prefix)
                gids.append(gid)
                sizes.append(len(s))
                ks.append(len(prefix))
            if not members:
                return []
            pairs = np.array(members, np.int64)
            home = (pairs[:, 0].astype(np.uint64) >> np.uint64(8)) % np.uint64(buckets)
            rows = []
            for b in np.unique(home):
                rows.append((int(b), 1, pairs[home == b].tobytes()))
            if not gids:
                return rows
            token = np.concatenate(tokens)
            owner = np.repeat(np.arange(len(gids)), ks)
            gid, size = np.array(gids, np.int64), np.array(sizes, np.int64)
            often = counts[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
            salts = np.maximum(-(-often // hot), 1).astype(np.uint64)
            salt = (gid[owner].astype(np.uint64) >> np.uint64(8)) % salts
            bucket = ((token >> np.uint64(8)) + salt * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)
            order = np.lexsort((owner, bucket))
            token, owner, bucket = token[order], owner[order], bucket[order]
            edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(edges, np.append(edges[1:], len(bucket))):
                who, n = np.unique(owner[a:b], return_counts=True)
                head = np.array([len(who)], "<i8").tobytes() + gid[who].tobytes() + size[who].tobytes() + n.astype("<i8").astype("<i4").tobytes()
                rows.append((int(bucket[a]), 0, head + token[a:b].tobytes()))
            return rows

        return step

    return map_rows(texts, "bucket long, kind int, data binary", start)


def _shared(entries: DataFrame, pct: int, counters, hot: int) -> DataFrame:
    """(token, gid, n, holders): entries whose shingle another group of a fitting size holds; and (gid, sid), token null:
    the sets of every group."""
    out = "token long, gid long, n long, holders long, sid long"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = pdf["kind"].to_numpy()
        pairs = np.unique(np.concatenate([np.frombuffer(d, np.int64).reshape(-1, 2) for d in pdf["data"][kinds == 1]] or [np.zeros((0, 2), np.int64)]), axis=0)
        tokens, gids, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for data in pdf["data"][kinds == 0]:
            g = int(np.frombuffer(data, "<i8", 1)[0])
            gid, size = np.frombuffer(data, "<i8", g, 8), np.frombuffer(data, "<i8", g, 8 + 8 * g)
            n = np.frombuffer(data, "<i4", g, 8 + 16 * g)
            tokens.append(np.frombuffer(data[8 + 20 * g :], np.uint64))
            gids.append(np.repeat(gid, n))
            sizes.append(np.repeat(size, n))
        token, gid, n = np.concatenate(tokens), np.concatenate(gids), np.concatenate(sizes)
        order = np.lexsort((gid, n, token))
        token, gid, n = token[order], gid[order], n[order]
        new = np.append(True, (token[1:] != token[:-1]) | (gid[1:] != gid[:-1]))[: len(token)]  # tasks may have sent the same group
        token, gid, n = token[new], gid[new], n[new]
        first = np.append(True, token[1:] != token[:-1])[: len(token)]
        held = np.diff(np.append(np.flatnonzero(first), len(token)))[np.cumsum(first) - 1]
        often = counters.value[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
        held = np.where(often > hot, often, held)  # dealt to several buckets: all that is known is the bound
        # by size, a group fits another one exactly if it fits one of its neighbours; entries dealt to several buckets all stay
        next_fits = np.append((token[1:] == token[:-1]) & (100 * n[:-1] >= pct * n[1:]), False)[: len(token)]
        some = next_fits | np.append(False, next_fits[:-1])[: len(token)] | (often > hot)
        k, m = int(some.sum()), len(pairs)
        pad = lambda x, before, after: pd.array(np.concatenate([np.zeros(before, np.int64), x, np.zeros(after, np.int64)]), "Int64")
        found = pd.DataFrame({"token": pad(token[some].astype(np.int64), 0, m), "gid": np.concatenate([gid[some], pairs[:, 0]]), "n": pad(n[some], 0, m), "holders": pad(held[some], 0, m), "sid": pad(pairs[:, 1], k, 0)})
        found.loc[k:, ["token", "n", "holders"]] = pd.NA
        found.loc[: k - 1, "sid"] = pd.NA
        return found

    return entries.groupBy("bucket").applyInPandas(merge, out)


def _fold(rows: DataFrame) -> DataFrame:
    """(gid, both, any): the AND and the OR of the bitmaps of a group's sets, folded in each task and then for each group."""
    out = schema_of("gid long, both binary, any binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for gid, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if gid in held:
                    held[gid] = held[gid][0] & x, held[gid][1] | y
                else:
                    held[gid] = x, y
        if held:
            columns = [pa.array(list(held), pa.int64()), *(pa.array([v[k].tobytes() for v in held.values()], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, schema=to_arrow_schema(out))

    partly = rows.select("gid", F.col("parity").alias("both"), F.col("parity").alias("any")).mapInArrow(run, out)
    return partly.repartition("gid").mapInArrow(run, out)


def _pairs(rows: DataFrame, pct: int, total: int, best: int | None) -> DataFrame:
    """Pairs (a < b, slack) of nodes that share a token, lie in different components and pass the size and bitmap filters.

    ``rows``: token, node, n, holders, comp, parity, any (null: the same as parity). A token's nodes are dealt to blocks; with
    ``best``, neighbouring blocks only are compared and each node keeps its ``best`` partners there; else all blocks are, and
    all pairs kept."""
    n_blocks = F.ceil(F.col("holders") / BLOCK)
    mine = F.pmod(F.xxhash64("node"), n_blocks)
    others = F.sequence(F.lit(0).cast("long"), n_blocks - 1) if best is None else F.array_distinct(F.array(mine, (mine + 1) % n_blocks, (mine + n_blocks - 1) % n_blocks))
    cells = rows.withColumn("mine", mine).withColumn("other", F.explode(others))
    cell = F.xxhash64("token", F.least("mine", "other"), F.greatest("mine", "other"))
    buckets = max(shuffle_width(rows.sparkSession), -(-total // TASK_ROWS))
    dealt = cells.select(cell.alias("cell"), F.pmod(F.xxhash64(cell), F.lit(buckets)).alias("bucket"), "node", "n", "comp", "parity", "any", (F.col("mine") <= F.col("other")).alias("low"), (F.col("mine") >= F.col("other")).alias("high"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell", "node"], kind="stable")
        node, who = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        at = np.zeros(len(node), np.int64)
        at[who] = np.arange(len(pdf))
        size, comp = pdf["n"].to_numpy()[at], pdf["comp"].to_numpy()[at]
        bits = np.frombuffer(b"".join(pdf["parity"].iloc[at]), np.uint64).reshape(len(node), PARITY_WORDS)
        apart_in = np.zeros_like(bits)  # cells in which a group's sets differ say nothing
        for k, data in enumerate(pdf["any"].iloc[at]):
            if data is not None:
                apart_in[k] = bits[k] ^ np.frombuffer(data, np.uint64)
        cell = pdf["cell"].to_numpy()
        low, high = pdf["low"].to_numpy(), pdf["high"].to_numpy()
        edges = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        found = np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        weight = 0

        def settle() -> np.ndarray:
            keys = np.unique(np.concatenate([found, *held]))
            a, b = keys // len(node), keys % len(node)
            big, small = np.maximum(size[a], size[b]), np.minimum(size[a], size[b])
            return keys[(comp[a] != comp[b]) & (100 * small >= pct * big)]

        ends = np.append(edges[1:], len(cell))
        width = ends - edges
        for m in np.unique(width):  # cells of one width at a time, without a Python step for each
            if m < 2:
                continue
            starts = edges[width == m]
            for some in np.array_split(starts, max(1, len(starts) * m * m // 500_000)):
                i, j = np.triu_indices(m, 1)
                x, y = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                apart = (low[x] & high[y]) | (low[y] & high[x])  # one from each of the cell's two blocks
                a, b = who[x[apart]], who[y[apart]]
                held.append(np.minimum(a, b) * len(node) + np.maximum(a, b))
                weight += len(a)
                if weight > 1_000_000:
                    found, held, weight = settle(), [], 0
        keys = settle() if held or len(found) else found
        slacks = []
        for some in np.array_split(keys, max(1, len(keys) // 50_000)):
            a, b = some // len(node), some % len(node)
            apart = np.bitwise_count((bits[a] ^ bits[b]) & ~(apart_in[a] | apart_in[b])).sum(1, dtype=np.int64)
            both = size[a] + size[b]
            slacks.append((both - apart) // 2 + (-pct * both) // (100 + pct))
        slack = np.concatenate(slacks) if slacks else np.zeros(0, np.int64)
        keys, slack = keys[slack >= 0], slack[slack >= 0]
        a, b = keys // len(node), keys % len(node)
        if best is not None and len(keys):
            ends_, row = np.concatenate([a, b]), np.tile(np.arange(len(keys)), 2)
            order = np.lexsort((row, -slack[row], ends_))
            ends_, row = ends_[order], row[order]
            first = np.flatnonzero(np.append(True, ends_[1:] != ends_[:-1]))
            rank = np.arange(len(ends_)) - np.repeat(first, np.diff(np.append(first, len(ends_))))
            chosen = np.unique(row[rank < best])
            a, b, slack = a[chosen], b[chosen], slack[chosen]
        return pd.DataFrame({"a": node[a], "b": node[b], "slack": slack})

    return dealt.groupBy("bucket").applyInPandas(compare, "a long, b long, slack long")


def _bitmap(ids: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of a column of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << WANTED_BITS, bool)
        for batch in batches:
            bits[_cells(batch.column(0).to_numpy())] = True
        packed = np.packbits(bits, bitorder="little")
        size = len(packed) // SLICES
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([packed[k * size : (k + 1) * size].tobytes() for k in range(SLICES)], pa.binary())], names=["slice", "data"])

    return _add_up(ids.mapInArrow(run, "slice int, data binary"), True, "u1", 1 << (WANTED_BITS - 3))


def _cells(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) & np.uint64((1 << WANTED_BITS) - 1)).astype(np.int64)


def _sets(source: DataFrame, width: int, wanted_docs, wanted_sets) -> DataFrame:
    """(sid, shingles) of the sets that the bitmaps may hold, once a task and set. Texts of other documents are not cut."""

    def start():
        docs, sets = wanted_docs.value, wanted_sets.value
        seen: set[int] = set()
        holds = lambda bits, cells: (bits[cells >> 3] >> (cells & 7).astype(np.uint8)) & 1

        def step(cols):
            ids, texts = cols
            known = np.array([i is not None for i in ids])
            cells = _cells(np.array([i or 0 for i in ids], np.int64))
            out = []
            for k in np.flatnonzero(~known | (holds(docs, cells) > 0)):
                s = shingles(texts[k], width)
                if not len(s):
                    continue
                sid = set_id(s)
                if sid not in seen and holds(sets, _cells(np.array([sid], np.int64)))[0]:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(sid)
                    out.append((sid, s.tobytes()))
            return out

        return step

    return map_rows(source, "sid long, hashes binary", start)


def _verify(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose full sets are similar enough."""
    left = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")

    def start():
        def step(cols):
            out = []
            for a, b, x, y in zip(*cols):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                z = np.concatenate([x, y])
                z.sort(kind="stable")
                shared = int((z[1:] == z[:-1]).sum())
                if (100 + pct) * shared >= pct * len(z):
                    out.append((a, b))
            return out

        return step

    return map_rows(both.select("a", "b", "x", "y"), "a long, b long", start)


def _once(sets: DataFrame) -> DataFrame:
    return sets.groupBy("sid").agg(F.first("hashes").alias("hashes"))


class _Join:
    """The steps that both results share: groups, candidates, verification."""

    def __init__(self, df: DataFrame, width: int, pct: int, id_col: str, text_col: str, scratch: Scratch):
        self.spark: SparkSession = df.sparkSession
        self.width, self.pct, self.scratch = width, pct, scratch
        context = self.spark.sparkContext
        self.source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        scanned = scratch.write(_scan(self.source, width), "scan")
        self.documents = scanned.where("slice is null")
        counts = _add_up(scanned.where("slice is not null").select("slice", "data"), False, "i8", 1 << SKETCH_BITS)
        counters = context.broadcast(counts)
        words = self.documents.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("d")).first()
        total = (words["n"] or 0) * (100 - pct) // 100 + words["d"]
        self.n_documents = words["d"]
        buckets = max(shuffle_width(self.spark), -(-total // TASK_ENTRIES))
        # a counter stands for several shingles: only what is far above the usual can be one that many groups hold
        hot = max(TASK_ENTRIES // 4, 8 * int(counts.mean()))
        kept = scratch.write(_shared(_entries(self.source.select("text"), width, pct, counters, buckets, hot), pct, counters, hot), "shared")
        self.shared = kept.where("token IS NOT NULL").select("token", "gid", "n", "holders")
        self.members = kept.where("token IS NULL").select("gid", "sid")
        self.n_shared = self.shared.count()
        #: One row a set; ``low`` is its smallest document id.
        self.sets_of = scratch.write(self.documents.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("wide").alias("wide"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "distinct")
        sizes = self.members.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.min("sid").alias("head"))
        single = sizes.where("m = 1").join(self.sets_of.select(F.col("sid").alias("head"), "parity"), "head").select("gid", "parity", F.lit(None).cast("binary").alias("any"))
        #: Members of groups that hold several sets, with the group's size.
        self.several = scratch.write(self.members.join(sizes.where("m > 1").select("gid", "m"), "gid").join(self.sets_of.select("sid", "n", "parity"), "sid"), "several")
        folded = _fold(self.several.select("gid", "parity")).select("gid", F.col("both").alias("parity"), "any")
        self.bitmaps = scratch.write(single.unionByName(folded), "bitmaps")
        self.sets: DataFrame | None = None

    def group_rows(self, comps: DataFrame | None = None) -> DataFrame:
        """The entries with their groups' bitmaps and components; without components each group is one of its own."""
        rows = self.shared.withColumn("comp", F.col("gid")) if comps is None else self.shared.join(comps, "gid")
        return rows.join(self.bitmaps, "gid").withColumnRenamed("gid", "node")

    def inside(self, roots: DataFrame | None = None) -> DataFrame:
        """Pairs (a, b) of different sets of one group that pass the bitmap filter and lie in different components."""
        rows = self.several.select(F.col("gid").alias("token"), F.col("sid").alias("node"), "n", F.col("m").alias("holders"), "parity", F.lit(None).cast("binary").alias("any"))
        if roots is None:
            rows = rows.withColumn("comp", F.col("node"))
        else:
            rows = rows.join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        return _pairs(rows, self.pct, self.n_shared, best=None).select("a", "b")

    def chains(self) -> DataFrame:
        """Pairs (a, b) that tie each group's sets together: neighbours in blocks of them, then the blocks' first ones."""
        block = F.pmod(F.xxhash64("sid"), F.ceil(F.col("m") / BLOCK))
        rows = self.several.select("gid", "sid", block.alias("block"))
        near = Window.partitionBy("gid", "block").orderBy("sid")
        firsts = rows.groupBy("gid", "block").agg(F.min("sid").alias("sid"))
        pairs = rows.select(F.lag("sid").over(near).alias("a"), F.col("sid").alias("b")).unionByName(firsts.select(F.lag("sid").over(Window.partitionBy("gid").orderBy("sid")).alias("a"), F.col("sid").alias("b")))
        return pairs.where("a IS NOT NULL")

    def expand(self, pairs: DataFrame, roots: DataFrame | None = None) -> DataFrame:
        """Group pairs as pairs (a < b) of their members, but for those that one component holds already."""
        members = self.members if roots is None else self.members.join(roots.withColumnRenamed("node", "sid"), "sid", "left")
        members = members.select("gid", "sid", (F.col("sid") if roots is None else F.coalesce("root", "sid")).alias("comp"))
        one = lambda end: members.select(F.col("gid").alias(end), F.col("sid").alias(f"s{end}"), F.col("comp").alias(f"c{end}"))
        both = pairs.select("a", "b").distinct().join(one("a"), "a").join(one("b"), "b").where("ca <> cb")
        return both.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the wide bitmaps cannot rule out; far smaller than the sets, they go first."""
        pct = self.pct
        left = self.sets_of.select(F.col("sid").alias("a"), F.col("n").alias("m"), F.col("wide").alias("x"))
        right = self.sets_of.select(F.col("sid").alias("b"), "n", F.col("wide").alias("y"))
        both = pairs.select("a", "b").join(left, "a").join(right, "b")

        def start():
            def step(cols):
                return [(a, b) for a, b, m, n, x, y in zip(*cols) if (100 + pct) * ((m + n - parity_distance(x, y)) // 2) >= pct * (m + n)]

            return step

        return map_rows(both.select("a", "b", "m", "n", "x", "y"), "a long, b long", start)

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs whose sets are similar enough, written. Sets are cut from the texts once."""
        context = self.spark.sparkContext
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        missing = wanted if self.sets is None else wanted.join(self.sets.select("sid"), "sid", "left_anti")
        if not missing.isEmpty():
            lows = missing.join(self.sets_of.select("sid", "low"), "sid").where("low IS NOT NULL")
            cut = _sets(self.source, self.width, context.broadcast(_bitmap(lows.select("low"))), context.broadcast(_bitmap(missing.select("sid"))))
            cut = self.scratch.write(cut, "sets")
            self.sets = cut if self.sets is None else self.sets.unionByName(cut)
        return self.scratch.write(_verify(pairs, _once(self.sets), self.pct) if self.sets is not None else pairs.limit(0), name)


def _roots(join: _Join) -> DataFrame:
    """(node, root) of every set that is linked with another one."""
    scratch, pct = join.scratch, join.pct
    first = _pairs(join.group_rows(), pct, join.n_shared, best=1)
    # of the partners found under its shingles each group tries the most promising one, and among those with smaller ids
    ends = first.groupBy("a", "b").agg(F.max("slack").alias("slack")).select("a", "b", "slack", F.explode(F.array("a", "b")).alias("who"))
    by = F.struct("slack", "a", "b")  # ties alike for all, so that near copies choose the same partner and end in one component
    chosen = ends.groupBy("who").agg(F.max_by(F.struct("a", "b"), by).alias("p"), F.max_by(F.struct("a", "b"), F.when(F.col("who") == F.col("b"), by)).alias("q"))
    chosen = chosen.select(F.explode(F.array("p", "q")).alias("p")).select("p.a", "p.b").where("a IS NOT NULL").distinct()
    heads = join.members.groupBy("gid").agg(F.min("sid").alias("sid"))
    one = lambda end: heads.select(F.col("gid").alias(end), F.col("sid").alias(f"s{end}"))
    tried = chosen.join(one("a"), "a").join(one("b"), "b").select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))
    tried = scratch.write(join.likely(tried.unionByName(join.chains()).distinct()), "tried")
    links = join.links(tried, "links")
    roots = scratch.write(components(links, scratch), "roots")

    # a group whose sets lie in several components counts as one more, so that nothing of it is passed over
    placed = join.members.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("root", "sid"))
    comps = placed.groupBy("gid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).select("gid", F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(F.col("gid")).alias("comp"))
    mixed = join.shared.join(comps, "gid").groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    left = _pairs(join.group_rows(comps).join(mixed, "token", "left_semi"), pct, join.n_shared, best=None)
    left = join.expand(left, roots).unionByName(join.inside(roots)).distinct().join(tried, ["a", "b"], "left_anti")
    rest = scratch.write(join.likely(left), "rest")
    if not rest.isEmpty():
        more = join.links(rest, "more")
        if not more.isEmpty():
            roots = scratch.write(components(links.unionByName(more), scratch), "final")
    return roots


def near_duplicates(df: DataFrame, width: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: documents link from a Jaccard similarity of ``pct`` percent."""
    scratch = scratch or Scratch(df.sparkSession, "setjoin")
    join = _Join(df, width, pct, id_col, text_col, scratch)
    roots = _roots(join)
    scratch.keep_only("scan", "distinct", "roots", "final")
    documents = join.documents
    # ids of components are smallest document ids; sets that are linked with none keep their own
    linked = salted_join(roots.withColumnRenamed("node", "sid").join(join.sets_of.select("sid", "low"), "sid"), _lowest(roots, join.sets_of), "root", "sid")
    named = join.sets_of.select("sid", "low").join(linked.select("sid", "component_id"), "sid", "left").select("sid", F.coalesce("component_id", "low").alias("component_id"))
    # sets with very many copies, at most 10,000 of them, go to the documents; the other documents go to their sets
    rows = documents.where("n > 0").select("doc_id", "n", "sid")
    heavy = join.sets_of.where(F.col("copies") > max(1_000, join.n_documents // 10_000)).select("sid")
    light = rows.join(F.broadcast(heavy), "sid", "left_anti").join(named, "sid")
    out = rows.join(F.broadcast(named.join(heavy, "sid")), "sid").unionByName(light).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = documents.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def _lowest(roots: DataFrame, sets_of: DataFrame) -> DataFrame:
    """(root, component_id): a row for each component of several sets."""
    named = roots.withColumnRenamed("node", "sid").join(sets_of.select("sid", "low"), "sid")
    return named.groupBy("root").agg(F.min("low").alias("component_id"))


def similar_sets(df: DataFrame, width: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Every link: pairs (a < b) of different sets that are similar enough, and (doc_id, sid), the set of each row (null: the
    empty one). Rows with one sid are linked with each other. All pairs that the filters leave are verified."""
    join = _Join(df, width, pct, id_col, text_col, Scratch(df.sparkSession, "setjoin"))
    pairs = _pairs(join.group_rows(), pct, join.n_shared, best=None)
    tried = join.scratch.write(join.likely(join.expand(pairs).unionByName(join.inside()).distinct()), "tried")
    links = join.links(tried, "links")
    join.scratch.keep_only("scan", "links")
    return links, join.documents.select("doc_id", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))


def link_counts(df: DataFrame, width: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sid and n_links of every row: how many other rows it is linked with."""
    links, rows = similar_sets(df, width, pct, id_col, text_col)
    sizes = rows.where("sid IS NOT NULL").groupBy("sid").agg(F.count(F.lit(1)).alias("size"))
    ends = links.select(F.col("a").alias("sid"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("sid"), F.col("a").alias("other")))
    others = ends.join(sizes.withColumnRenamed("sid", "other"), "other").groupBy("sid").agg(F.sum("size").alias("others"))
    counts = sizes.join(others, "sid", "left").select("sid", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return rows.join(counts, "sid", "left").select("doc_id", "sid", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(df: DataFrame, width: int = 5, pct: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose id is their component's: one document of each group, with all columns.
    Rows that share an id are kept or dropped together; rows without an id all stay."""
    scratch = Scratch(df.sparkSession, "setjoin")
    groups = near_duplicates(df, width, pct, id_col, text_col, scratch)
    name = "_gone"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, df[id_col].cast("long") == gone[name], "left_anti")
