"""Best-fit packing of token sequences with Martello-Toth dominance reduction.

Texts are tokenised whole; only longer ones are cut. Packing happens on the histogram of piece
lengths, which has at most ``capacity`` entries however many pieces there are: the reduction
fixes small sets that provably dominate every alternative (a piece with which nothing fits; two
that fill a sequence exactly; a piece and the largest that fits, where no more than that can be
gained), then best-fit decreasing fills the rest, whole classes of equal pieces at a time. The
result is a list of patterns with multiplicities. Pieces find their place by their rank among
the pieces of their length: counted in each task, offset by a running sum over tasks.

The driver holds the histogram and the patterns only (bounded by ``capacity``), and no group of
equal lengths ever meets in one task.

``pack_in_order`` keeps an order of the texts: it packs bounded windows of consecutive texts, each by
itself and in one task, and numbers the sequences window after window. Defined results: a null text is an empty one and has the
end id alone; repeated rows are packed as often as they occur; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftmark.llm.common import Capped, Scratch, map_rows

_PLAIN = re.compile(r"[\x21-\x7eß-öø-ÿ]+")
#: The vocabulary's own split of a chunk without white space, for ASCII and Latin-1 lower-case letters.
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def shared_encoder(path: str) -> "WordEncoder":
    """One encoder a Python worker: what it has learnt serves the worker's later tasks."""
    return WordEncoder(path)


class WordEncoder:
    """Ids of a word-end BPE vocabulary, as packed little-endian 32-bit numbers, memoised by chunk.

    Chunks between ASCII white space are independent of each other in this vocabulary (white space only separates),
    so a text's ids are its chunks' ids in a row. Plain chunks go through byte-pair merges directly, with the word end as byte 0,
    which they never hold; all others through the full tokenizer, among them those with the strings of special tokens, which
    stand for these tokens."""

    def __init__(self, path: str, cache: int = 150_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        alphabet = _byte_alphabet()
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {}
        for token, k in vocabulary.items():
            core = token.removesuffix("</w>")
            if all(c in alphabet for c in core):
                raw = bytes(alphabet[c] for c in core)
                if 0 not in raw:
                    ranks[raw + (b"\0" if core != token else b"")] = k
        self.merges = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks | {b"\0": len(vocabulary)}, special_tokens={})
        self.known, self.pieces = Capped(cache), Capped(cache)

    def chunk(self, raw: bytes) -> bytes:
        chunk = raw.decode("utf-8", "surrogatepass")
        low = chunk.lower()
        if "<|" in chunk or not _PLAIN.fullmatch(low):
            return _packed(self.full.encode(chunk, add_special_tokens=False).ids)
        if low.isalpha():
            return self.piece(low)
        return b"".join(map(self.piece, _SPLIT.findall(low)))

    def piece(self, piece: str) -> bytes:
        known = self.pieces
        ids = known.get(piece)
        if ids is None:
            known.room()
            ids = known[piece] = _packed(self.merges.encode_ordinary(piece + "\0"))
        return ids

    def packed(self, text: str) -> bytes:
        known = self.known
        words = text.encode("utf-8", "surrogatepass").split()  # at ASCII white space alone
        out = list(map(known.get, words))
        if None in out:
            for k, ids in enumerate(out):
                if ids is None:
                    w = words[k]
                    ids = known.get(w)
                    if ids is None:
                        known.room()
                        ids = known[w] = self.chunk(w)
                    out[k] = ids
        return b"".join(out)


Pattern = tuple[tuple[int, int], ...]  # (length, how many) of one sequence


def dominant_sets(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Fix dominating sets; ``counts`` keeps what is left."""
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for i in sorted(counts, reverse=True):
            while counts.get(i):
                partner = _dominant_partner(i, counts, capacity)
                if partner is None:
                    break
                changed = True
                if partner == 0:
                    n, pattern = counts[i], ((i, 1),)
                elif partner == i:
                    n, pattern = counts[i] // 2, ((i, 2),)
                else:
                    n, pattern = min(counts[i], counts[partner]), ((i, 1), (partner, 1))
                fixed.append((pattern, n))
                for size, k in pattern:
                    counts[size] -= k * n
                    if not counts[size]:
                        del counts[size]
    return fixed


def _dominant_partner(i: int, counts: Mapping[int, int], capacity: int) -> int | None:
    """0: nothing fits beside i; a length: {i, that length} dominates; None: undecided."""
    room = capacity - i
    free = lambda s: counts.get(s, 0) - (s == i)
    sizes = sorted(s for s in counts if s <= room and free(s) > 0)
    if not sizes:
        return 0
    best = sizes[-1]
    if best == room:
        return best
    small: list[int] = []
    for s in sizes[:3]:
        small += [s] * min(3, free(s))
    if len(small) < 2 or small[0] + small[1] > room:
        return best  # one more piece at most: the largest
    if len(small) < 3 or sum(small[:3]) > room:  # two more at most: does any pair gain more than the largest alone?
        lo, hi, pair = 0, len(sizes) - 1, 0
        while lo <= hi:
            if lo == hi and free(sizes[lo]) < 2:
                break
            total = sizes[lo] + sizes[hi]
            if total <= room:
                pair = max(pair, total)
                lo += 1
            else:
                hi -= 1
        if best >= pair:
            return best
    return None


def best_fit(counts: Mapping[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing over length classes: each goes to the open sequences with the least room that holds it."""
    open_: dict[int, list[list]] = {}  # room: [pattern, how many sequences]
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append([pattern, n])

    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                pattern, n = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, pattern, n = capacity, (), left
            each = room // s
            full = min(n, left // each)
            put(room - each * s, (*pattern, (s, each)), full)
            left -= full * each
            n -= full
            if n and left:  # fewer than ``each`` remain: they share one sequence
                put(room - left * s, (*pattern, (s, left)), 1)
                n -= 1
                left = 0
            if pattern:
                put(room, pattern, n)
    return [(p, n) for groups in open_.values() for p, n in groups]


def plan(counts: Mapping[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    left = dict(counts)
    fixed = dominant_sets(left, capacity)
    return fixed + best_fit(left, capacity)


def seats(patterns: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first rank, first sequence, how many in a sequence, offset; one entry for each pattern that holds it."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    base = 0
    for pattern, n in patterns:
        offset = 0
        for size, k in pattern:
            at = rank.get(size, 0)
            out.setdefault(size, []).append((at, base, k, offset))
            rank[size] = at + k * n
            offset += k * size
        base += n
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows)) for size, rows in out.items()}


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every text, with the task that cut them and their rank among its pieces of the same length."""

    def start():
        encode = shared_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()

        def step(cols):
            out = []
            for i, text in zip(*cols):
                ids = encode.packed(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    length = len(part) // 4
                    rank = seen[length] = seen.get(length, -1) + 1
                    out.append((i, k, at // 4, length, zlib.crc32(part), task, rank))
            return out

        return step

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"
    return map_rows(df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), schema, start)


def pack(df: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece, with its sequence and its place there."""
    spark = df.sparkSession
    cut = Scratch(spark, "packing").write(pieces(df, tokenizer, capacity, end_id, id_col, text_col), "pieces")
    by_task = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    held = seats(plan(counts, capacity))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = cut.join(by_task.select("length", "task", before.alias("before")), ["length", "task"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def start():
        def step(cols):
            out = []
            for *row, length, crc, rank in zip(*cols):
                ranks, bases, each, offsets = held[length]
                k = bisect_right(ranks, rank) - 1
                far = rank - int(ranks[k])
                n = int(each[k])
                out.append((*row, length, crc, int(bases[k]) + far // n, int(offsets[k]) + far % n * length))
            return out

        return step

    return map_rows(ranked.select(*columns, (F.col("before") + F.col("rank")).alias("rank")), SCHEMA, start)


def stored_order(df: DataFrame) -> DataFrame:
    """``df`` with its order as two columns: ``_file`` and ``_row`` from 0 in it. For a table that is read, its files by name
    and their rows, however readers deal them out; for any other frame its partitions and their rows."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        return df.withColumns({"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")})
    at = F.monotonically_increasing_id()
    return df.withColumns({"_file": F.lpad(F.shiftright(at, 33).cast("string"), 10, "0"), "_row": at.bitwiseAND((1 << 33) - 1)})


def pack_in_order(df: DataFrame, tokenizer: str, window: int, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``pack`` for each ``window`` consecutive texts, in the order in which ``df`` is stored: sequences of earlier windows come first."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")

    def start():
        encode = shared_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()

        def step(cols):
            out = []
            for i, text, file, row in zip(*cols):
                ids = encode.packed(text or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((i, k, at // 4, len(part) // 4, zlib.crc32(part), file, row))
            return out

        return step

    texts = stored_order(df).select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), "_file", "_row")
    cut = scratch.write(map_rows(texts, "doc_id long, piece int, start long, length long, ids_crc32 long, file string, row long", start), "pieces")
    before, starts = 0, []
    for r in sorted(cut.where("piece = 0").groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a file
        starts.append((r["file"], before))
        before += r["n"]
    if not starts:
        return spark.createDataFrame([], SCHEMA)
    firsts = F.broadcast(spark.createDataFrame(starts, "file string, first long"))
    placed = cut.join(firsts, "file").withColumn("place", F.col("first") + F.col("row")).drop("file", "first", "row").withColumn("window", F.floor(F.col("place") / window))

    def seat(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["place", "piece"])
        held = seats(plan({int(s): int(n) for s, n in pdf["length"].value_counts().items()}, capacity))
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        lengths = pdf["length"].to_numpy()
        for size, (ranks, bases, each, offsets) in held.items():
            at = np.flatnonzero(lengths == size)
            k = np.searchsorted(ranks, np.arange(len(at)), side="right") - 1
            far = np.arange(len(at)) - ranks[k]
            sequence[at], offset[at] = bases[k] + far // each[k], offsets[k] + far % each[k] * size
        return pdf.drop(columns=["place"]).assign(sequence_id=sequence, offset=offset)

    seated = scratch.write(placed.groupBy("window").applyInPandas(seat, f"{SCHEMA}, window long"), "seated")
    before, starts = 0, []
    for r in sorted(seated.groupBy("window").agg(F.max("sequence_id").alias("last")).collect()):  # a row for ``window`` texts
        starts.append((r["window"], before))
        before += r["last"] + 1
    firsts = F.broadcast(spark.createDataFrame(starts, "window long, first long"))
    scratch.keep_only("seated")
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return seated.join(firsts, "window").select(*columns, (F.col("first") + F.col("sequence_id")).alias("sequence_id"), "offset")
