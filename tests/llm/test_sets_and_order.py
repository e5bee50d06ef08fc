"""Ranking, chat collapse, mixing, packing, set join and nearest neighbours on small tables."""

import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("weftmark.llm")
from weftmark.llm import ann, chat, components, forest, mixing, packing, ranking, setjoin
from weftmark.llm.common import Scratch
from weftmark.llm.queries import vocabulary

BPE = vocabulary("word_bpe_49k.json")


# ---- quality classifier
def labelled(spark, n=400):
    draw = random.Random(1)
    rows, labels = [], []
    words = "the of and to in a is that it for was on are as with quiet river stone window letter garden morning".split()
    for i in range(n):
        good = i % 3 > 0
        text = " ".join(draw.choices(words, k=60)) + "." if good else " ".join(w + draw.choice(("***", "$$$", "%%%")) for w in draw.choices(words, k=60))
        rows.append((i, text, "x", i % 2))
        if i % 4:
            labels.append((i, int(good), 0))
    labels += [(5, None, 0), (None, 1, 0), (9, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, score string, predicted int"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ranking_learns_and_thresholds(spark):
    docs, labels = labelled(spark)
    got = {r["doc_id"]: r for r in ranking.score_quality(docs, labels).collect()}
    assert len(got) == 400
    right = [(r["predicted"] == int(i % 3 > 0)) for i, r in got.items() if r["held_out"]]
    assert sum(right) / len(right) > 0.97
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for i, r in got.items())


def test_ranking_ignores_held_out_labels(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("quality", F.when(ranking.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in ranking.score_quality(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_ranking_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "long " * 300_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in ranking.score_quality(docs, none).collect()] == [1] * 4
    assert ranking.keep_good(docs, none).count() == 4
    full, labels = labelled(spark)
    got = ranking.score_quality(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    kept = ranking.keep_good(full, labels)
    assert kept.columns == full.columns and {r["doc_id"] for r in kept.collect()} <= set(range(400))


def test_ranking_takes_an_id_once(spark):
    """Repeated ids, equal texts and ties: one fitted row an id, equal scores for equal texts."""
    docs, labels = labelled(spark, 120)
    again = docs.where("doc_id = 8").crossJoin(spark.range(500)).drop("id")
    many = docs.unionByName(again)
    one, two = (ranking.train(d, labels) for d in (docs, many))
    assert np.allclose(one.weights, two.weights) and one.cut_at == two.cut_at
    scores = {r["score"] for r in ranking.score_quality(many.where("doc_id = 8"), labels).collect()}
    assert len(scores) <= 1
    assert ranking.score_quality(spark.createDataFrame([(1, "long " * 300_000), (2, None)], "doc_id long, text string"), labels).count() == 2


def test_ranking_minimises_the_pairs_loss():
    """Weights against a plain gradient descent on all sampled pairs; the cut is the bad rows' quantile."""
    draw = np.random.default_rng(3)
    x = draw.normal(size=(80, len(ranking.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 3] + draw.normal(size=80) > 0).astype(int)
    model = ranking.fit(x, y, ridge=0.05)
    z = ranking.expand((x - model.mean) / model.scale)
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    order = np.random.default_rng(7)
    n = 8 * max(len(good), len(bad))
    d = z[np.resize(order.permutation(good), n)] - z[order.permutation(np.resize(bad, n))]
    w = np.zeros(d.shape[1])
    for _ in range(6000):
        w -= 0.2 * (0.05 * w - (d / (1 + np.exp(d @ w))[:, None]).mean(0))
    assert np.allclose(w, model.weights, atol=2e-3)
    u = np.sort(z @ model.weights)
    assert (u < model.cut_at).sum() == len(bad)


# ---- chat
TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "more"), (3, 0, "user", "hi"),
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"), (5, 0, "user", "hi"), (5, 1, "assistant", "other"), (6, 5, None, None), (6, None, "user", "x"),
    (None, 0, "user", "lost"), (7, 0, "user", "a"), (7, 0, "user", "a"), (8, 0, "user", "a"), *[(9, k, "user", f"t{k}") for k in range(1000)], *[(10, k, "user", f"t{k}") for k in range(600)],
]


def test_snapshots(spark):
    by = {}
    for c, t, role, text in TURNS:
        by.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    conv = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in by.items()}
    whole = {}
    for c, v in conv.items():
        whole[v] = min(filter(lambda x: x is not None, (whole.get(v), c)), default=None)
    want = {c: v for v, c in whole.items() if not any(len(w) > len(v) and w[: len(v)] == v for w in whole)}
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("pos", F.lit("clash")).withColumn("h0", F.lit(1))
    got = {}
    for r in chat.collapse_and_render(df, block=64).collect():
        got.setdefault(r["conv_id"], []).append((r["pos"], r["rendered"], r["n_turns"]))
    assert got.keys() == want.keys()
    for c, v in want.items():
        assert [x[1] for x in sorted(got[c])] == [f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in v] and {x[2] for x in got[c]} == {len(v)}
    assert chat.collapse_and_render(df.limit(0)).count() == 0


def test_snapshots_of_hot_and_very_long_turns(spark):
    """Many equal and null turns in one conversation, a very long text, and copies that differ at its end alone."""
    long = "x " * 400_000
    turns = [(1, None, "user", f"n{k % 7}") for k in range(3000)] + [(1, 5, "user", "same")] * 2000 + [(2, 0, "user", long), (3, 0, "user", long), (3, 1, "user", "b"), (4, 0, "user", long + "y")]
    got = Counter()
    for r in chat.collapse_and_render(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)).collect():
        got[r["conv_id"], r["n_turns"]] += 1
    assert got == {(1, 5000): 5000, (3, 2): 2, (4, 1): 1}


# ---- mixing
def check_lag(slots, weights):
    total, seen = sum(weights.values()), Counter()
    for t, s in enumerate(slots, 1):
        seen[s] += 1
        assert all(abs(seen[x] - t * w / total) < 1 for x, w in weights.items())


def test_edf_keeps_every_lag_below_one():
    draw = random.Random(2)
    for _ in range(40):
        weights = {f"s{k}": draw.randint(1, 20) for k in range(draw.randint(1, 9))}
        check_lag(mixing.edf_period(weights), weights)


def test_mix(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["a"] * 6 + ["b", "c", None, "zz"])) for i in range(3000)] + [(7, "a"), (7, "a"), (None, "b")]
    df = spark.createDataFrame(rows, "doc_id long, source string").withColumns({"a": F.lit(1), "slot": F.lit("x"), "_mix_s": F.lit(0)})
    weights = {"a": 3, "b": 2, "c": 2}
    got = sorted(tuple(r) for r in mixing.mix_plan(df, weights=weights, other=1, block_size=10).select("slot", "place", "source", "doc_id", "block").collect())
    assert len(got) == len(rows) and Counter(r[3] for r in got) == Counter(i for i, _ in rows)
    assert len({r[:2] for r in got}) == len(got)
    by_slot = {}
    for slot, place, source, _, block in got:
        by_slot.setdefault(slot, set()).add((source, block))
    assert all(len(v) == 1 for v in by_slot.values()) and sorted(by_slot) == list(range(len(by_slot)))
    order = [next(iter(by_slot[t]))[0] for t in sorted(by_slot)]
    target = weights | {mixing.OTHER_NAME: 1}
    least = min(math.ceil(sum(s == x for s in order) / 1) // w for x, w in target.items())
    check_lag(order[: least * sum(target.values())], target)
    again = mixing.in_mix_order(df, weights=weights, other=1, block_size=10)
    assert again.columns == df.columns and again.count() == len(rows)
    assert mixing.mix_plan(df.limit(0)).count() == 0


def brute_mix(counts, weights, block):
    """The source and block of every slot, slot by slot: of the released blocks that are left the earliest deadline, ties by name."""
    left, done, out = {s: -(-n // block) for s, n in counts.items() if n}, dict.fromkeys(counts, 0), []
    while left:
        # whole periods while every source has blocks for one, then one short period
        whole = all(n >= weights[s] for s, n in left.items())
        parts = {s: weights[s] if whole else min(n, weights[s]) for s, n in left.items()}
        period, sent = sum(parts.values()), dict.fromkeys(parts, 0)
        for t in range(period):
            ready = [(-(-(sent[s] + 1) * period // a), s) for s, a in parts.items() if sent[s] < a and sent[s] * period // a <= t]
            s = min(ready)[1]
            out.append((s, done[s] + sent[s]))
            sent[s] += 1
        for s in parts:
            done[s] += parts[s]
            left[s] -= parts[s]
        left = {s: n for s, n in left.items() if n}
    return out


def test_mix_matches_a_plain_scheduler(spark):
    draw = random.Random(17)
    for weights, block in (({"a": 3, "b": 2, "c": 1}, 4), ({"a": 5, "b": 1}, 1), ({"a": 1, "b": 1, "c": 7}, 3)):
        rows = [(k, draw.choice(["a", "a", "a", "b", "c", None]), "x" * 50_000 if k == 3 else "t", {"k": str(k)}) for k in range(230)] + [(5, "a", "t", {"k": "5"})] * 3 + [(None, "b", "n", None)] * 2
        df = spark.createDataFrame(rows, "doc_id long, source string, text string, extra map<string,string>").repartition(3)
        plan, p = mixing.mix(df, weights, other=1, block_size=block)
        got = {}
        for r in plan.collect():
            got.setdefault(r[f"{p}slot"], []).append((r[f"{p}source"], r[f"{p}block"], r[f"{p}place"]))
        counts = Counter(s if s in weights else mixing.OTHER_NAME for _, s, *_ in rows)
        want = brute_mix(counts, weights | {mixing.OTHER_NAME: 1}, block)
        assert [got[t][0][:2] for t in sorted(got)] == want and sorted(got) == list(range(len(want)))
        assert all(sorted(x[2] for x in v) == list(range(len(v))) and len({x[:2] for x in v}) == 1 for v in got.values())
        assert sum(map(len, got.values())) == len(rows)


# ---- packing
def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(BPE)
    draw = random.Random(6)
    odd = ["l'été IT'S 12ab <|endoftext|> ß ΣΑΣ İ \x1f a b", "中文 😀 é", None, "", "   ", "word, word. (word) don't!!", "a <|endoftext|> b", "x<|startoftext|>y<|endoftext|>", "<| endoftext|> <|ENDOFTEXT|>"]
    texts = odd + [" ".join(draw.choices(["alpha", "Beta,", "gamma's", "déjà", "x1y2"], k=draw.randint(1, 120))) for _ in range(300)] + ["tail " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("length", F.lit("x")).repartition(3)
    got = packing.pack(df, BPE, capacity=128).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = full.encode(t or "", add_special_tokens=False).ids + [1]
        parts = sorted(by[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        for r in parts:
            piece = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes()) and (r["length"] == 128 or r is parts[-1])
        assert sum(r["length"] for r in parts) == len(ids)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in sequences.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 128
    assert len(sequences) <= 1.01 * -(-sum(r["length"] for r in got) // 128) + 1
    assert packing.pack(df.limit(0), BPE).count() == 0


def test_dominance_is_optimal_on_small_instances():
    """Fixing dominant sets never costs a sequence: exhaustive packing of the rest reaches the exhaustive optimum."""

    def optimum(items, capacity):
        items, best = sorted(items, reverse=True), [len(items)]

        def place(k, bins):
            if len(bins) >= best[0]:
                return
            if k == len(items):
                best[0] = len(bins)
                return
            for room in set(bins):
                if room >= items[k]:
                    rest = list(bins)
                    rest.remove(room)
                    place(k + 1, [*rest, room - items[k]])
            place(k + 1, [*bins, capacity - items[k]])

        place(0, [])
        return best[0]

    draw = random.Random(8)
    for _ in range(150):
        items = [draw.randint(1, 12) for _ in range(draw.randint(1, 8))]
        left = Counter(items)
        fixed = packing.dominant_sets(left, 12)
        rest = list(left.elements())
        assert sum(n for _, n in fixed) + (optimum(rest, 12) if rest else 0) == optimum(items, 12)
        assert all(sum(s * k for s, k in p) <= 12 for p, _ in packing.plan(Counter(items), 12))


def test_packing_reaches_the_lower_bound(spark):
    """The whole pieces of real documents need no more sequences than their tokens."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(df, BPE).agg(F.sum("length").alias("tokens"), F.countDistinct("sequence_id").alias("sequences")).first()
    assert got["sequences"] == -(-got["tokens"] // 4096)


def test_words_have_the_tokenizers_ids():
    from tokenizers import Tokenizer

    full, encoder = Tokenizer.from_file(BPE), packing.WordEncoder(BPE)
    draw = random.Random(2)
    for _ in range(400):
        text = "".join(draw.choices("abcdefghijklmnopqrstuvwxyzéßÿ0123456789'.,-!", k=draw.randint(1, 24)))
        assert np.frombuffer(encoder.packed(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids, text


# ---- near duplicates
def brute_groups(rows, pct=80):
    def shingles(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= pct * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(i, low.get(find(k), i))
    return sorted((i, len(sets[k]), low.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows) if i is not None)


def near_rows():
    draw = random.Random(11)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = [(100, None), (101, ""), (102, " \n"), (103, "one two"), (104, "ONE  two"), (105, "one two three four five"), (106, "x " * 3000), (107, "x " * 2999)]
    passage = draw.choices(vocabulary, k=60)
    for g in range(12):
        base = draw.choices(vocabulary, k=draw.randint(20, 120)) + (passage if g % 3 == 0 else [])
        for _ in range(draw.choice((1, 2, 12))):
            words = list(base)
            for _ in range(draw.randint(0, 4)):
                words[draw.randrange(len(words))] = draw.choice(vocabulary)
            rows.append((1000 - len(rows), " ".join(words)))
    big = draw.choices(vocabulary, k=140)
    for _ in range(60):
        words = list(big)
        for _ in range(draw.randint(0, 6)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
        rows.append((5000 + len(rows), " ".join(words)))
    return rows + [rows[-1], (None, rows[-1][1])]


def test_near_duplicates_match_brute_force(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sid": F.lit(1), "n": F.lit("x")}).repartition(3)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.near_duplicates(df).collect() if r["doc_id"] is not None)
    assert got == brute_groups(rows)
    kept = setjoin.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == {c for i, _, c in got if i == c}


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Hot shingles cut into blocks and dealt to several buckets give the same groups."""
    monkeypatch.setattr(setjoin, "BLOCK", 7)
    monkeypatch.setattr(setjoin, "TASK_ENTRIES", 80)
    monkeypatch.setattr(setjoin, "TASK_ROWS", 500)
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.near_duplicates(df).collect() if r["doc_id"] is not None)
    assert got == brute_groups(rows)


def grouped_rows():
    """Texts that share their rarest shingles and their size by sixes: some of them near copies, some not."""
    draw = random.Random(5)
    word = lambda tag, n: [f"{tag}{k}" for k in range(n)]
    tails = []
    common = draw.choices(word("c", 300), k=95)
    for j in range(6):
        tail = list(common)
        if j < 4:
            tail[20 + 15 * j] = f"v{j}"
        else:
            tail[10:50] = draw.choices(word("d", 300), k=40)
        tails.append(tail)
    rows = [(100 * i + j, " ".join(word(f"r{i}x", 40) + tails[j])) for i in range(9) for j in range(6)]
    return rows + [(7000 + k, rows[k][1].upper()) for k in range(5)]


def test_near_duplicates_of_very_many_copies(spark):
    rows = [(9000 - k, "one two three four five six seven " + "x" * (k % 2)) for k in range(2600)] + [(1, "alone with other words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = Counter((r["component_id"], r["n_shingles"]) for r in setjoin.near_duplicates(df).collect())
    assert got == {(6402, 3): 1300, (6401, 4): 1300, (1, 1): 1}


def brute_links(rows, pct=80):
    words = [t.lower().split() for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in words]
    linked = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= pct * len(a | b)
    return sorted((i, sum(linked(sets[k], sets[m]) for m in range(len(rows)) if m != k)) for k, (i, _) in enumerate(rows))


def test_groups_of_several_sets(spark, monkeypatch):
    """Sets with equal prefixes and sizes are one group; its members link with each other or not, and all links are found."""
    rows = grouped_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sizes = []
    fold = setjoin._fold
    monkeypatch.setattr(setjoin, "_fold", lambda members: sizes.append(members.groupBy("gid").count().agg(F.max("count")).first()[0]) or fold(members))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in setjoin.near_duplicates(df).collect())
    assert sizes == [6] and got == brute_groups(rows)
    counts = sorted((r["doc_id"], r["n_links"]) for r in setjoin.link_counts(df).collect())
    assert counts == brute_links(rows)


def test_link_counts_match_brute_force(spark):
    rows = [(i, t) for i, t in near_rows() if i is not None and t is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert sorted((r["doc_id"], r["n_links"]) for r in setjoin.link_counts(df).collect()) == brute_links(rows)


def test_near_duplicates_of_a_very_long_text(spark):
    words = [f"w{k % 7919}x{k % 13}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-900])), (3, " ".join(words[: len(words) // 2])), (4, " ".join(words))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in setjoin.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_near_duplicates_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert setjoin.near_duplicates(none).count() == 0 and setjoin.keep_one(none).count() == 0


def test_parity_bound():
    draw = np.random.default_rng(1)
    for _ in range(50):
        a, b = (np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (700, 90))
        b = np.unique(np.concatenate([b, a[: draw.integers(0, 600)]]))
        assert setjoin.parity_distance(setjoin.wide_parity(a), setjoin.wide_parity(b)) <= len(np.setxor1d(a, b))


def test_components(spark):
    draw = random.Random(3)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + draw.randrange(50), 1000 + draw.randrange(50)) for _ in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(x, find(x)) for a, b in edges if a != b for x in (a, b)}


def test_component_rounds_broadcast_nothing(spark, monkeypatch):
    """Each round is one plan without broadcasts, which would pass through the driver; the session's setting comes back."""
    plans, write = [], Scratch.write

    def seen(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(Scratch, "write", seen)
    edges = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(20, 21)], "a long, b long")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    got = {tuple(r) for r in components.components(edges, Scratch(spark, "test")).collect()}
    assert got == {(k, 0) for k in range(10)} | {(20, 20), (21, 20)}
    assert plans and not any("Broadcast" in p or "AdaptiveSparkPlan" in p for p in plans)
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


# ---- nearest neighbours
def test_nearest(spark):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(20, 16))
    x = (centres[draw.integers(0, 20, 1500)] + 0.3 * draw.normal(size=(1500, 16))).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 16), (2002, [math.nan] * 16), (2003, [1.0, None] + [0.0] * 14), (2004, [1.0] * 3), (None, x[0]), (5, x[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"rank": F.lit("x"), "leaf": F.lit(0)})
    got = {}
    for r in ann.nearest(df, probes=24, leaf=60, sample=700).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    a = np.array(x)
    assert sorted(got) == list(range(0, 1500, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and len({f[1] for f in found}) == 20 and q not in {f[1] for f in found}
        assert np.allclose([f[2] for f in found], a[[f[1] for f in found]] @ a[q], rtol=1e-12, atol=1e-12)
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        scores = a @ a[q]
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1500), -scores))[:20]) & {f[1] for f in found})
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 5.0])], schema)
    assert [tuple(r) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, -1.0)]
    same = spark.createDataFrame([(k, [0.5, 0.5]) for k in range(300)], schema)
    assert [r["vec_id"] for r in ann.nearest(same).where("query_id = 0").orderBy("rank").collect()] == list(range(1, 21))


def test_nearest_of_an_id_with_many_rows(spark):
    """Repeated rows, and many vectors of one id, take one place each query."""
    draw = np.random.default_rng(7)
    x = (np.ones(8) + 0.05 * draw.normal(size=(41, 8))).tolist()
    hot = (3 * np.ones((60, 8)) + 0.01 * draw.normal(size=(60, 8))).tolist()
    rows = [(k, v) for k, v in enumerate(x)] + [(900, v) for v in hot] + [(901, [2.0] * 8)] * 70
    got = [tuple(r) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()]
    scores = {k: float(np.dot(v, x[0])) for k, v in enumerate(x) if k} | {900: max(float(np.dot(v, x[0])) for v in hot), 901: float(np.dot([2.0] * 8, x[0]))}
    want = sorted(scores, key=lambda k: (-scores[k], k))[:20]
    assert [r[2] for r in got] == want and np.allclose([r[3] for r in got], [scores[k] for k in want])


def test_forest_visits_every_leaf_if_asked():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(500, 8))
    trees = [forest.build(x, 40, draw) for _ in range(3)]
    for q in x[:5]:
        visited = forest.search(trees, q, 10_000)
        assert len(visited) == len(set(visited)) == sum(t.leaves for t in trees)
        assert visited[0][1] == forest.leaves_of(trees[visited[0][0]], q[None])[0]


# ---- pipeline
def test_pipeline_stages_keep_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(spark)
    docs = docs.select("doc_id", F.concat("text", F.lit(" mail me@x.org number "), F.col("doc_id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("src"), F.col("doc_id") % 3).alias("source"), F.lit(0).cast("long").alias("n_chars"))
    docs = docs.unionByName(docs.where("doc_id < 30").withColumn("doc_id", F.col("doc_id") + 1000))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / f"{k}"))
        now = spark.read.parquet(str(tmp_path / f"{k}"))
        sizes.append(now.count())
        if name == "near_duplicates":
            assert not now.where("doc_id >= 1000").count()
        if name == "personal_data":
            assert not now.where(F.col("text").contains("@")).count() and now.where("n_chars <> length(text)").count() == 0
    assert sizes[0] < 430 and sizes[1] < sizes[0] and sizes[1] == sizes[2] == sizes[3] == sizes[4]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(whole.columns) == sorted(now.columns)
    assert sorted((r["doc_id"], r["ids_crc32"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids_crc32"]) for r in now.collect())


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Null, empty and very long texts, null and repeated ids, null sources, repeated rows, clashing columns; then empty tables."""
    import corpus_pipeline

    labels = labelled(spark, 60)[1]
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows = [
        (None, None, None, None, None), (None, "the of and to in a is that " * 20, "en", "src0", 5), (1, None, "en", None, 0), (2, "", "en", "src1", 0), (2, "", "en", "src1", 0), (3, "the river of stone and quiet " * 30, "en", "nowhere", 7),
        (3, "the river of stone and quiet " * 30, "en", "nowhere", 7), (4, "the river of stone and quiet " * 30, "en", "src0", 7), (5, "the of and to in is it was " * 60_000, "en", "src0", 9), (6, "mail a@b.org the of and in a " * 9, "en", "src2", 9),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2)
    extra = ["sid", "n", "comp", "token", "root", "_gone", "_mix_slot", "block", "spans", "score", "i", "y", "_file", "window", "map"]
    docs = docs.withColumns({c: F.lit(1) for c in extra[:-1]} | {"map": F.create_map(F.lit("a"), F.lit(1))})
    now, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < 4:
            assert now.columns == columns, name
        now.write.parquet(str(tmp_path / f"odd{k}"))
        before, now = now, spark.read.parquet(str(tmp_path / f"odd{k}"))
        if name == "near_duplicates":
            ids = Counter(r["doc_id"] for r in now.collect())
            assert ids[4] == 0 and {3, 5, 6} & set(ids) and ids[None] >= 1
        if name == "personal_data":
            assert not now.where(F.col("text").contains("@")).count() and now.where("text is null").count() == now.where("text is null and n_chars <=> coalesce(n_chars, n_chars)").count()
    assert sum(r["length"] for r in now.collect() if r["doc_id"] == 5) > 4096 * 50
    nothing = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, nothing, str(tmp_path))
        assert got.count() == 0 and (name == "sequences" or got.columns == columns), name


def test_pipeline_leaves_only_what_its_result_reads(spark, tmp_path):
    import os

    import corpus_pipeline

    docs, labels = labelled(spark, 90)
    docs.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("src1").alias("source"), F.lit(0).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    got = corpus_pipeline.run(spark, str(tmp_path))
    left = {name for d in set(os.listdir(folder)) - before for name in os.listdir(f"{folder}/{d}") if not name.startswith(".")}
    assert {name.split("-")[0] for name in left} <= {"mixture", "seated"} and got.count() > 0


def test_entry_guard_holds_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['corpus_pipeline'] = None\nimport importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name in ('corpus_pipeline', 'weftmark.llm'):\n            raise ModuleNotFoundError(name=name)\ndel sys.modules['corpus_pipeline']\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e, json\nprint(json.dumps(sorted(e.queries())))"
    names = json.loads(subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout)
    assert names and not any(n.startswith("op") for n in names) and "pipeline" not in names


@pytest.mark.parametrize("stored", [True, False])
def test_pipeline_sequences_follow_the_mix(spark, tmp_path, stored):
    """Every prefix of whole windows holds the sources by their weights, though lengths differ by source."""
    import corpus_pipeline

    window = mixing.PERIOD * mixing.BLOCK
    rows = [(i, ("tail " if i % 2 else "word ") * (1 + i % (7 if i % 2 else 90)), f"src{i % 2}") for i in range(3 * window)]
    docs = corpus_pipeline.mixture(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    if stored:
        docs.write.parquet(str(tmp_path / "mixed"))
        docs = spark.read.parquet(str(tmp_path / "mixed"))
    got = sorted(corpus_pipeline.sequences(spark, docs, "").select("sequence_id", "offset", "doc_id", "length").collect())
    assert sorted(r["doc_id"] for r in got) == list(range(3 * window))
    share = mixing.WEIGHTS["src0"] / (mixing.WEIGHTS["src0"] + mixing.WEIGHTS["src1"])
    for n in (window, 2 * window):
        assert abs(sum(r["doc_id"] % 2 == 0 for r in got[:n]) - share * n) <= mixing.BLOCK
    assert sorted({r["sequence_id"] for r in got}) == list(range(got[-1]["sequence_id"] + 1))
    room = {}
    for r in got:
        assert r["offset"] == room.get(r["sequence_id"], 0)
        room[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(room.values()) <= 4096 and len(room) <= 1.01 * sum(room.values()) / 4096 + 3
