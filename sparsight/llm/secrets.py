"""Secret scans: fixed patterns, and a battery of randomness tests on other long tokens.

The patterns give the base spans. Every further run of token characters is cut at its inner equals signs, and every part
of 20 or more characters is tested under the encoding that it seems to use (the smallest alphabet that holds its
characters). A part that no alphabet holds is cut at its separators, in each way that leaves one alphabet. Its symbols must look drawn uniformly at random from that
alphabet: a chi-squared test of uniformity, a runs test about the middle of the alphabet and a test of serial correlation,
combined by Fisher's method. And it must not look like a word: its evidence is the likelihood ratio of uniform symbols
against the document's own letter pairs. Under the null that the token is text, the ratio exceeds t with probability at
most 1/t, so ratios are e-values; the e-value form of the step-up procedure then bounds the share of false findings among
a document's tokens, however dependent. The evidence grows with length, so short tokens need to be more extreme.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: In the order that ties of start are listed in.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of 32 or more among all runs
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: What equals signs leave of a run, with the padding at its end; what separators leave of a part that no alphabet holds.
_PART = re.compile(r"[^=]+(?:=+\Z)?")
_PIECES = (re.compile(r"[^+/]+"), re.compile(r"[^_-]+"), re.compile(r"[^/_-]+"))
#: Least characters of a token under test; share of false findings among a document's findings; level of the battery.
LEAST_TOKEN = 20
FALSE_SHARE = 0.01
BATTERY_LEVEL = 0.001
#: Alphabets by name, in the order they are tried: the first that holds a token's characters is its encoding.
ENCODINGS = (
    ("decimal", "0123456789"),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("lower", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("BASE36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
_SETS = [(name, frozenset(a), {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
SPAN = "array<struct<kind: string, start: int, end: int>>"


def infer_encoding(token: str) -> tuple[str, list[int], int] | None:
    """(encoding, symbol numbers, alphabet size) of a token without padding; None if no alphabet holds it."""
    symbols = set(token)
    for name, known, place in _SETS:
        if symbols <= known:
            return name, [place[c] for c in token], len(known)
    return None


def _chi_squared_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees >= x), by the cube-root normal approximation."""
    if k <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(symbols: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation under symbols drawn uniformly from `size`; small ones speak against."""
    n = len(symbols)
    expected = n / size
    above = _chi_squared_tail(sum((c - expected) ** 2 for c in Counter(symbols).values()) / expected + (size - len(set(symbols))) * expected, size - 1)
    uniform = 2 * min(above, 1 - above)  # too even is no more random than too uneven
    high = [2 * s >= size for s in symbols]
    ones = sum(high)
    zeros = n - ones
    if ones and zeros:
        mean = 2 * ones * zeros / n + 1
        variance = (mean - 1) * (mean - 2) / (n - 1)
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        by_runs = _two_sided((runs - mean) / math.sqrt(variance)) if variance > 0 else 1.0
    else:
        by_runs = 2.0 ** (1 - n)
    x = np.asarray(symbols, dtype=float)
    x -= x.mean()
    spread = float(x @ x)
    by_serial = _two_sided(float(x[1:] @ x[:-1]) / spread * math.sqrt(n)) if spread else size ** (1.0 - n)
    return uniform, by_runs, by_serial


def looks_random(symbols: list[int], size: int, level: float = BATTERY_LEVEL) -> bool:
    """Whether Fisher's combination of the battery stays above the level."""
    statistic = -2 * sum(math.log(max(p, 1e-300)) for p in battery(symbols, size))
    half = statistic / 2  # the tail for six degrees, exactly
    return math.exp(-half) * (1 + half + half * half / 2) >= level


class LetterPairs:
    """How the document's own text puts characters together, without the tokens under test; a plain mixture where it is silent."""

    #: Chances by class where nothing else is known: of a letter, a digit, another character.
    PRIOR = {"a": 0.9 / 26, "A": 0.04 / 26, "0": 0.04 / 10, "-": 0.02 / 8}
    PSEUDO = 4.0

    def __init__(self, text: str):
        self.pairs = Counter(zip(text, text[1:]))
        self.firsts = Counter(text[:-1])

    def log2(self, token: str) -> float:
        total, last = 0.0, " "
        for c in token:
            prior = self.PRIOR["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-"]
            total += math.log2((self.pairs[last, c] + self.PSEUDO * prior) / (self.firsts[last] + self.PSEUDO))
            last = c
        return total


def _base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the pattern matches, leftmost and non-overlapping within a kind, failing ones dropped."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


def _encoded_as(token: str) -> tuple[str, list[int], int] | None:
    """The encoding of a token, also of one that dashes or underscores group."""
    return infer_encoding(token) or infer_encoding(token.replace("-", "")) or infer_encoding(token.replace("_", ""))


def _tokens(text: str) -> list[tuple[int, int, str, tuple[str, list[int], int]]]:
    """(start, end, token without padding, its encoding) of all that is to be tested, by start; pieces of one part may overlap."""
    found = []
    for run in _TOKEN.finditer(text):
        for m in _PART.finditer(run[0]):
            if len(m[0]) < LEAST_TOKEN:
                continue
            start, token = run.start() + m.start(), m[0].rstrip("=")
            if known := _encoded_as(token):
                found.append((start, run.start() + m.end(), token, known))
                continue
            padding = len(m[0]) - len(token)
            pieces = {}
            for pattern in _PIECES:
                for piece in pattern.finditer(token):
                    end = piece.end() + (padding if piece.end() == len(token) else 0)
                    if end - piece.start() >= LEAST_TOKEN:
                        pieces[piece.start(), end] = piece[0]
            found += [(start + a, start + b, piece, _encoded_as(piece)) for (a, b), piece in sorted(pieces.items())]
    return found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans by start, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def _apart(tested: list, found: list[tuple[int, int, int]]) -> list:
    """Those of the tokens under test that no span found so far overlaps."""
    taken = _merged([(start, end) for start, _, end in found])
    starts = [start for start, _ in taken]
    out = []
    for t in tested:
        last = bisect_left(starts, t[1]) - 1  # of the spans that begin before the token ends
        if last < 0 or taken[last][1] <= t[0]:
            out.append(t)
    return out


def scan(text: str) -> list[tuple[int, int, int]]:
    """All spans of a text as (start, kind number, end), sorted; ends are exclusive, in code points."""
    found = _base(text)
    tested = _apart(_tokens(text), found)
    if tested:
        rest, at = [], 0
        for start, end in _merged([t[:2] for t in tested]):
            rest.append(text[at:start])
            at = end
        rest.append(text[at:])
        pairs = LetterPairs(" ".join(rest))
        evidence = []
        for start, end, token, known in tested:
            if len(known[1]) > 1 and looks_random(known[1], known[2]):
                evidence.append((-len(known[1]) * math.log2(known[2]) - pairs.log2(token), start, end))
        evidence.sort(reverse=True)
        kept = max((k for k, (e, _, _) in enumerate(evidence, 1) if e >= math.log2(len(tested) / (k * FALSE_SHARE))), default=0)
        found += [(start, 3, end) for start, end in _merged([e[1:] for e in evidence[:kept]])]
    return sorted(found)


def secret_spans(column: Column) -> Column:
    """Spans (kind, start, end) of a text column, by start, then kind; none for null and empty texts. Whole texts are scanned."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        offsets, rows = [0], []
        for t in texts.to_pylist():
            rows += scan(t) if t else []
            offsets.append(len(rows))
        starts, kinds, ends = zip(*rows) if rows else ((), (), ())
        flat = pa.StructArray.from_arrays([pa.array([KINDS[k] for k in kinds], pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(kind))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return spans(column)


def redact(column: Column, replacement: str = "[secret]") -> Column:
    """The text with every secret replaced (overlapping spans as one); null stays null, texts without secrets stay as they are."""

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts.to_pylist():
            parts, at = [], 0
            for start, _, end in scan(t) if t else []:
                if start >= at:
                    parts += [t[at:start], replacement]
                at = max(at, end)
            out.append("".join([*parts, t[at:]]) if at else t)
        return pa.array(out, pa.string())

    return masked(column)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def op9_randomness_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every whole text; null texts count as empty, an empty table gives no rows, rows that repeat are kept."""
    found = table(spark, sf_dir, "documents").select("doc_id", secret_spans(text_of()).alias("s"))
    count = lambda k: F.size(F.filter("s", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]],
        F.sha2(joined(F.filter("s", lambda x: x.kind != "random")), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
    )
