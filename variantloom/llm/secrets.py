"""Operator 5: secret scanning by a battery of randomness tests.

Base spans come from three patterns (a keyword with a value, access keys, long
hexadecimal runs). Beyond them, every maximal run of key characters is a candidate,
and so is a run of such parts joined by dots where each part is long enough; other
dotted runs are candidates part by part. A candidate's encoding is inferred from its
characters alone (hexadecimal, base 32, one case, two cases, base 36, alphanumeric,
base 64), which fixes the alphabet that it should be uniform over. The battery:

* chi-squared of the character counts against the uniform alphabet;
* runs above and below the alphabet's middle (Wald-Wolfowitz);
* lag-1 serial correlation of the character values.

Each test is read twice. Under the random hypothesis a candidate that any test rejects
(Bonferroni over the three) is not random. Under the hypothesis of ordinary text
(identifiers, paths, slugs, counters) each statistic gets a p-value for being as much
like a random string as it is; the moments are those of made-up text of the same
encoding and length (``calibration``). The three are combined into one p-value by a
weighted Stouffer rule with their measured covariance. Within a document, candidates are
accepted by a weighted Benjamini-Hochberg rule on the combined p-values, the weights
proportional to length, so long strings, on which the tests have power, get more of
the error budget than short ones. A document's result depends on its own text alone.
Runs of digits only are numbers, not keys, and are not tested.

Defined cases:

* null and empty texts have no spans (the digest of the empty string);
* texts of any length are scanned whole; offsets are code points, ends exclusive;
* repeated rows and equal or null ids are scanned one by one; an empty table gives an empty result;
* other columns of the input are not looked at (``remove_secrets`` keeps them as they are).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import ne

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import table

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: The least lengths of a value, an access key, a hexadecimal run and a candidate of the tests.
MIN_VALUE, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 12, 18, 16, 20
#: Parts of a dotted candidate have this many characters at least.
MIN_PART = 8
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*={0,2}")
_PART = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{20,}")
_HEX_SEED = re.compile(r"[0-9a-f]{16,}")
#: False discoveries among accepted candidates; level of the three tests together.
FDR, TEST_LEVEL = 0.01, 0.001
#: Made-up strings for the moments, and the lengths at which they are taken (longer strings are judged by the last).
DRAWS, LENGTHS = 500, (20, 22, 24, 28, 32, 40, 52, 64, 100, 200)
_ORDER = {c: i for i, c in enumerate("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_")}


def _letters(first: int) -> dict[str, int]:
    return {chr(first + i): i for i in range(26)}


#: Alphabets in the order of their values.
ALPHABETS = {
    "hex": {c: int(c, 16) for c in "0123456789abcdefABCDEF"},
    "base32": _letters(65) | {str(i): 24 + i for i in range(2, 8)},
    "lower": _letters(97),
    "upper": _letters(65),
    "letters": _letters(97) | {c: 26 + i for c, i in _letters(65).items()},
    "base36": {c: int(c, 36) for c in "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"},
    "alnum": {c: i for c, i in _ORDER.items() if i < 62},
    "base64": {c: min(i, 63) if c in "+/" else i - 2 if i >= 64 else i for c, i in _ORDER.items()},
}
SIZES = {"hex": 16, "base32": 32, "lower": 26, "upper": 26, "letters": 52, "base36": 36, "alnum": 62, "base64": 64}


def encoding(s: str) -> str | None:
    """The narrowest encoding that a candidate without dots can be in; None for digits and marks alone."""
    digits, lower, upper = any("0" <= c <= "9" for c in s), any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s)
    marks = any(not c.isalnum() for c in s)
    if not (lower or upper):
        return None
    if marks:
        return "base64"
    if not digits:
        return "letters" if lower and upper else "lower" if lower else "upper"
    if lower and upper:
        return "alnum"
    if all(c in ALPHABETS["hex"] for c in s):
        return "hex"
    if upper and all(c in ALPHABETS["base32"] for c in s):
        return "base32"
    return "base36"


def _normal_tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def statistics(s: str, name: str) -> tuple[float, float, float, float]:
    """(chi-squared, runs, share of characters above the middle, serial correlation) of s in an encoding."""
    alphabet, size, n = ALPHABETS[name], SIZES[name], len(s)
    v = [alphabet[c] for c in s]
    chi = sum(c * c for c in Counter(v).values()) * size / n - n
    up = [2 * x >= size for x in v]
    runs = 1 + sum(map(ne, up, up[1:]))
    mid = sum(v) / n
    spread = sum((x - mid) ** 2 for x in v)
    r = sum((x - mid) * (y - mid) for x, y in zip(v, v[1:], strict=False)) / spread if spread else 1.0
    return chi, float(runs), sum(up) / n, r


def battery(s: str, name: str, found: tuple[float, float, float, float] | None = None) -> tuple[float, float, float]:
    """p-values of the chi-squared, runs and serial-correlation tests of s under the random hypothesis."""
    chi, runs, share, r = found or statistics(s, name)
    n, df = len(s), SIZES[name] - 1
    p_chi = _normal_tail(((max(chi, 0) / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    a = round(share * n)
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _normal_tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    return p_chi, min(p_runs, 1.0), min(2 * _normal_tail(abs(r + 1 / n) * math.sqrt(n)), 1.0)


def unlikeness(s: str, name: str, found: tuple[float, float, float, float] | None = None) -> tuple[float, float, float]:
    """The three statistics on scales that hardly depend on the length: log chi-squared per degree, runs per place, correlation."""
    chi, runs, _, r = found or statistics(s, name)
    n = len(s)
    return math.log((max(chi, 0.0) + n) / (SIZES[name] - 1 + n)), (runs - 1) / (n - 1), r


_WORDS = "the and for with this that from have state value index table query stream result window parse handler config service manager client request response version update create delete select report summary account customer order product price total number string array object module package system process thread memory buffer record field column format language project public private static method return error warning message source target output input file path user name group role session key data time date year month history section chapter image video article world people government development international information".split()
_HEX_WORDS = "dead beef cafe face feed babe added decade facade bad fade deed bead ace abed dad fee".split()


def _made_up(r: random.Random, style: int, n: int) -> str:
    """A string of n characters as text has them: identifiers, constants, paths, slugs, numbers."""
    out = ""
    while len(out) < n:
        w = r.choice(_WORDS)
        digits = "".join(r.choices("0123456789", k=r.choice([1, 1, 2, 4]))) if r.random() < 0.12 else ""
        if style == 0:
            out += w.capitalize() + digits
        elif style == 1:
            out += (w if r.random() < 0.7 else w.capitalize()) + r.choice(["_", "-", "/"]) + digits
        elif style == 2:
            out += w.upper() + "".join(c for c in digits if c in "234567")
        elif style == 3:
            out += w
        elif style == 4:
            out += w.upper()
        elif style == 5:
            out += r.choice(_HEX_WORDS) + r.choice(["", "", "00", "01", "2024", "0000", digits])
        elif style == 6:
            out += w.capitalize()
        else:
            out += w + (digits or r.choice(["", "1", "2"]))
    return out[:n]


@lru_cache(maxsize=4)
def calibration(draws: int = DRAWS, seed: int = 5) -> dict[str, list[tuple[int, tuple[float, ...], tuple[float, ...], float]]]:
    """Per encoding and length: the mean of ``unlikeness`` over made-up text, the weights of its parts, and the deviation of their sum.

    The weights are Fisher's between made-up text and random strings; the deviation is the larger of the measured one and
    of that which puts one in a hundred made-up texts at a p-value of 0.01.
    """
    r, out = random.Random(seed), {}
    for name, style in (("hex", 5), ("base32", 2), ("lower", 3), ("upper", 4), ("letters", 6), ("base36", 7), ("alnum", 0), ("base64", 1)):
        alphabet, size, long = ALPHABETS[name], SIZES[name], LENGTHS[-1]
        text = np.array([[alphabet[c] for c in _made_up(r, style, long)] for _ in range(draws)])
        noise = np.random.default_rng(seed).integers(0, size, (draws, long))
        rows = []
        for n in LENGTHS:
            x, y = (np.concatenate([_many(v[:, i * n : i * n + n], size) for i in range(min(long // n, 4))]) for v in (text, noise))
            mean = x.mean(0)
            w = np.linalg.solve(np.cov((x - mean).T) + np.diag([1e-5] * 3), y.mean(0) - mean)
            z = np.sort((x - mean) @ w)
            rows.append((n, tuple(mean.tolist()), tuple(w.tolist()), float(max(z.std(), z[int(len(z) * 0.99)] / 2.326))))
        out[name] = rows
    return out


def _many(v: np.ndarray, size: int) -> np.ndarray:
    """``unlikeness`` of every row of alphabet values."""
    m, n = v.shape
    counts = np.bincount((np.arange(m)[:, None] * size + v).ravel(), minlength=m * size).reshape(m, size)
    up, c = 2 * v >= size, v - v.mean(1, keepdims=True)
    chi = (counts**2).sum(1) * size / n - n
    spread = (c * c).sum(1)
    r = np.where(spread > 0, (c[:, 1:] * c[:, :-1]).sum(1) / np.where(spread > 0, spread, 1), 1.0)
    return np.column_stack([np.log((np.maximum(chi, 0) + n) / (size - 1 + n)), (up[:, 1:] != up[:, :-1]).sum(1) / (n - 1), r])


def text_p(s: str, name: str, moments: dict | None = None, found: tuple[float, float, float, float] | None = None) -> float:
    """The battery's combined p-value under the hypothesis of ordinary text: as random as s is, or more."""
    rows = (moments or calibration())[name]
    n, mean, w, scale = max((r for r in rows if r[0] <= len(s)), default=rows[0])
    return _normal_tail(sum((v - m) * k for v, m, k in zip(unlikeness(s, name, found), mean, w, strict=True)) / scale)


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, characters to test) of the runs and dotted runs that are long enough."""
    for run in _LONG.finditer(text):
        for m in CANDIDATE.finditer(text, run.start(), run.end()):
            if m.end() - m.start() < MIN_RANDOM:
                continue
            parts = m[0].rstrip("=").split(".")
            if len(parts) == 1:
                yield m.start(), m.end(), parts[0]
            elif min(map(len, parts)) >= MIN_PART:
                yield m.start(), m.end(), "".join(parts)
            else:
                for x in _PART.finditer(text, m.start(), m.end()):
                    yield x.start(), x.end(), x[0].rstrip("=")


def random_spans(text: str, fdr: float = FDR, level: float = TEST_LEVEL, moments: dict | None = None) -> list[tuple[int, int]]:
    """Spans of text that pass the battery and the length-weighted false-discovery rule."""
    tested = []
    for lo, hi, s in candidates(text):
        name = encoding(s)
        if name is None or len(s) < MIN_RANDOM:
            continue
        found = statistics(s, name)
        fits = 3 * min(battery(s, name, found)) >= level
        tested.append((text_p(s, name, moments, found) if fits else 1.0, len(s), lo, hi))
    if not tested:
        return []
    mean = sum(x[1] for x in tested) / len(tested)
    ranked = sorted((p * mean / n, lo, hi) for p, n, lo, hi in tested)
    keep = max((i + 1 for i, x in enumerate(ranked) if x[0] <= fdr * (i + 1) / len(ranked)), default=0)
    return sorted((lo, hi) for _, lo, hi in ranked[:keep])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that are long enough, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    # A run found from 16 characters on is the same maximal run that the plain pattern finds.
    out += [(m.start(), 2, m.end()) for m in _HEX_SEED.finditer(text)]
    return sorted(out)


def scan(text: str | None, moments: dict | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, as (start, kind, end) in order; a tested span inside a base span adds nothing."""
    text = text or ""
    base = base_spans(text)
    more = [(lo, 3, hi) for lo, hi in random_spans(text, moments=moments) if not any(s <= lo and hi <= e for s, _, e in base)]
    return base, sorted(base + more)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones taken together, replaced by [SECRET]."""
    out, at = [], 0
    for s, _, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[SECRET]"]
        at = e
    return "".join(out) + text[at:]


def _scanned(moments: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text in batch.column("text"):
                base, spans = scan(text.as_py(), moments)
                for k in range(3):
                    cols[k].append(sum(x[1] == k for x in base))
                cols[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[4].append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of docs(doc_id, text)."""
    text = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return text.mapInArrow(_scanned(calibration()), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def remove_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in ``text`` replaced; nulls stay null, and ``n_chars``, where present, follows the new text."""

    moments = calibration()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else redact(t, scan(t, moments)[1]) for t in (x.as_py() for x in batch.column("text"))]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, "text", pa.array(out, pa.string()))

    schema = StructType([StructField("text", StringType()) if f.name == "text" else f for f in docs.schema.fields])
    clean = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(kind))
    return clean


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return find_secrets(table(spark, sf_dir, "documents"))
