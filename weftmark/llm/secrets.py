"""Secret scans: assignment, access-key and hex rules, and a randomness test battery.

Battery: every run of at least ``least`` key characters of a text is a candidate. Its encoding is inferred from
the characters it holds; three tests then compare it with uniform draws from that alphabet:
chi-squared of the symbol counts, Wald-Wolfowitz runs about the alphabet's middle, and lag-1
serial correlation. Fisher's method combines them; a candidate for which the combined p-value is below ``reject`` is no key.
For the rest the null hypothesis is written language: the chi-squared statistic that letters at written
frequencies would give, with its exact mean and variance, gives a left-tail p-value. Digits alone are dates and amounts as
often as keys: their p-value is 1.

False-discovery control is over the corpus, by a weighted Benjamini-Hochberg step: a candidate's weight rises with its length,
since short strings have little power. A first pass counts the weighted p-values of all candidates on a fixed logarithmic
scale (its steps bound what reaches the driver); the step on that scale gives one threshold, which a second pass applies.
All p-values are normal approximations, rough for short candidates and far tails.

Two narrow passes; the shuffle between them carries one row a step and task. Defined results: a null text is an empty one (no
spans); texts of any length are read whole; equal rows give equal rows; an empty table gives no rows; extra columns are
ignored. Spans are code points, end exclusive, by start, then by the order of ``KINDS``, then by end.
"""

from __future__ import annotations

import hashlib
import math
import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftmark.llm.common import map_rows, per_text

KINDS = ("assign", "access", "hex", "random")
BASE = KINDS[:3]
_RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
#: One of them is in every assignment; a cheap look before the pattern.
_KEYWORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Only runs that reach the least length are worth a match object; a run is maximal either way.
_HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Steps a power of ten, and how many of them, of the scale on which p-values are counted.
STEPS, SCALE = 50, 2_000
#: Characters from which on a candidate has full weight.
FULL = 40

#: Alphabets, tried from the narrowest; "mixed" holds what the others do not.
ENCODINGS: dict[str, str] = {
    "decimal": string.digits,
    "lower": string.ascii_lowercase,
    "upper": string.ascii_uppercase,
    "hex": string.digits + "abcdef",
    "HEX": string.digits + "ABCDEF",
    "base32": string.ascii_uppercase + "234567",
    "base36": string.digits + string.ascii_lowercase,
    "BASE36": string.digits + string.ascii_uppercase,
    "base62": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
    "base64url": string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_",
    "mixed": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/-_",
}
#: Written English letters a to z, in 1000ths (public frequency tables).
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
_LETTER = np.array(LETTERS, float) / sum(LETTERS)


def _written(alphabet: str) -> np.ndarray:
    """Symbol shares if words were written in this alphabet: letters in one case at their usual shares, a trace of the rest."""
    lower = any(c.islower() for c in alphabet)
    share = np.full(len(alphabet), 0.05 / len(alphabet))
    for k, c in enumerate(alphabet):
        if c.isalpha() and (c.islower() or not lower):
            share[k] += 0.95 * _LETTER[ord(c.lower()) - 97]
    return share / share.sum()


class _Alphabet:
    def __init__(self, symbols: str):
        self.k = len(symbols)
        self.index = np.full(128, -1)
        self.index[[ord(c) for c in symbols]] = np.arange(self.k)
        self.set = frozenset(symbols)
        q = _written(symbols) if any(c.isalpha() for c in symbols) else None
        # moments of sum n_i^2 under multinomial(n, q): power sums
        self.p2, self.p3 = (float((q**2).sum()), float((q**3).sum())) if q is not None else (0.0, 0.0)

    def squares(self, n: int) -> tuple[float, float]:
        """Mean and variance of the sum of squared counts for n symbols at written shares."""
        mean = n + n * (n - 1) * self.p2
        var = 2 * n * (n - 1) * (self.p2 + 2 * (n - 2) * self.p3 - (2 * n - 3) * self.p2**2)
        return mean, max(var, 1e-9)


_TABLE = {name: _Alphabet(symbols) for name, symbols in ENCODINGS.items()}


def encoding_of(s: str) -> str:
    held = set(s)
    return next((name for name, a in _TABLE.items() if held <= a.set), "mixed")


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def fisher(*p: float) -> float:
    """The combined p-value of independent ones: the upper tail of chi-squared with two degrees of freedom for each."""
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    term = total = 1.0
    for k in range(1, len(p)):
        term *= half / k
        total += term
    return min(1.0, math.exp(-half) * total)


def battery(s: str) -> tuple[str, float, float, float, float]:
    """Encoding; p-values of uniformity (too uneven), runs and serial correlation (two-sided) for uniform draws;
    p-value of the evenness for written language (small: too even for words)."""
    s = s.rstrip("=")
    name = encoding_of(s)
    a = _TABLE[name]
    x = a.index[np.frombuffer(s.encode("ascii"), np.uint8)]
    n, k = len(x), a.k
    counts = np.bincount(x, minlength=k).astype(float)
    squares = float((counts**2).sum())
    chi = squares * k / n - n
    z = (chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    p_uniform = 1 - _normal_cdf(z)
    up = x >= k / 2
    n1 = int(up.sum())
    n2 = n - n1
    if n1 and n2:
        runs = 1 + int((up[1:] != up[:-1]).sum())
        mean = 1 + 2 * n1 * n2 / n
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * (1 - _normal_cdf(abs(runs - mean) / math.sqrt(max(var, 1e-9))))
    else:
        p_runs = 2.0 ** (1 - n)
    d = x - x.mean()
    var = float((d**2).sum())
    p_serial = 2 * (1 - _normal_cdf(abs(float((d[1:] * d[:-1]).sum()) / var + 1 / n) * math.sqrt(n))) if var else 0.0
    if a.p2:
        mean, var = a.squares(n)
        p_text = _normal_cdf((squares - mean) / math.sqrt(var))
    else:
        p_text = 1.0  # digits alone are dates and amounts as often as keys
    return name, p_uniform, p_runs, p_serial, p_text


def candidates(text: str, least: int = 20, reject: float = 1e-3) -> list[tuple[tuple[int, int], float, float]]:
    """(span, p-value, weight) of every candidate; the p-value is 1 for those that the battery tells from uniform draws."""
    out = []
    for m in re.finditer(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{least},}}={{0,2}}", text):
        _, uniform, runs, serial, p = battery(m[0])
        n = len(m[0].rstrip("="))
        out.append((m.span(), p if fisher(uniform, runs, serial) >= reject else 1.0, min(n, FULL) / FULL))
    return out


def step_of(p: float, weight: float) -> int:
    """Where p / weight lies on the scale: the larger, the smaller it is."""
    return max(0, min(SCALE, math.floor(-STEPS * math.log10(max(p / weight, 1e-300)))))


def threshold(counts: dict[int, tuple[int, float]], fdr: float) -> int:
    """The least step whose candidates are discoveries, from (candidates, sum of weights) by step; SCALE + 1 for none.
    Weighted p-values are p * (mean weight) / weight; every candidate of a step counts with the step's upper end."""
    total = sum(n for n, _ in counts.values())
    if not total:
        return SCALE + 1
    mean = sum(w for _, w in counts.values()) / total
    found, best = 0, SCALE + 1
    for step in sorted(counts, reverse=True):
        found += counts[step][0]
        if step and 10 ** (-step / STEPS) * mean <= fdr * found / total:
            best = step
    return best


def secret_spans(text: str, least_step: int, least: int = 20, reject: float = 1e-3) -> list[tuple[str, int, int]]:
    """Spans by the rules, and the candidates from ``least_step`` on."""
    low = text.lower()
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8] if any(k in low for k in _KEYWORDS) else []
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in _HEX_LONG.finditer(text)]
    out += [("random", *span) for span, p, weight in candidates(text, least, reject) if step_of(p, weight) >= least_step]
    out.sort(key=lambda s: (s[1], _RANK[s[0]], s[2]))
    return out


def corpus_threshold(df: DataFrame, fdr: float, least: int, reject: float, text_col: str) -> int:
    """``threshold`` over all candidates of all texts."""

    def start():
        def step(cols):
            counts: dict[int, list] = {}
            for text in cols[0]:
                for _, p, weight in candidates(text or "", least, reject):
                    held = counts.setdefault(step_of(p, weight), [0, 0.0])
                    held[0] += 1
                    held[1] += weight
            return [(k, n, w) for k, (n, w) in counts.items()]

        return step

    found = map_rows(df.select(F.col(text_col).cast("string")), "step int, n long, w double", start)
    rows = found.groupBy("step").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()  # SCALE + 1 rows at most
    return threshold({r["step"]: (r["n"], r["w"]) for r in rows}, fdr)


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int>>"
DIGEST = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"


def find_secrets(df: DataFrame, fdr: float = 0.01, least: int = 20, reject: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's spans as an array of structs. ``fdr``: expected share of false discoveries among the corpus's battery findings;
    ``least``: characters of a candidate; ``reject``: level at which the battery tells a candidate from uniform draws."""
    least_step = corpus_threshold(df, fdr, least, reject, text_col)

    def start():
        return lambda text: ([{"kind": k, "start": a, "end": b} for k, a, b in secret_spans(text or "", least_step, least, reject)],)

    return per_text(df, SPANS, start, id_col, text_col)


def secret_digest(df: DataFrame, fdr: float = 0.01, least: int = 20, reject: float = 1e-3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans as one string, for each row."""
    least_step = corpus_threshold(df, fdr, least, reject, text_col)

    def start():
        def one(text: str | None) -> tuple:
            found = secret_spans(text or "", least_step, least, reject)
            base = [s for s in found if s[0] in BASE]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            return *(sum(s[0] == k for s in base) for k in BASE), digest, joined(found), len(found) - len(base)

        return one

    return per_text(df, DIGEST, start, id_col, text_col)
