"""Operator 1: document fingerprints by consistent weighted sampling.

A document is a weighted set: its words (lower-cased, split at white space) by
count. For each of SAMPLES hash functions, every word draws r ~ Gamma(2, 1),
c ~ Gamma(2, 1) and beta ~ U(0, 1) from its hash; a word of weight w gets the
level t = floor(ln w / r + beta) and the value ln a = ln c - r (t - beta + 1); the
sample is the (word, t) of the least value (Ioffe, 2010). Two documents agree on
a sample with a probability that is their generalised Jaccard similarity
sum min(w, w') / sum max(w, w').

The draws depend on the word and the sample only, so a document and a variant of
it share one row per word with two weights, and each draw is made once for both.
Rows are dealt by ranges of doc_id; the counts per (document, word) and the
minima per document then need no further shuffle. Only DataFrame functions run.

Defined cases:

* a null text is the empty text; a text without words has the fingerprint of zeros, likeness 1 to another such and
  0 to any other;
* rows with equal or null ``doc_id`` are documents of their own, ordered by a hash of their text (null ids come last in
  descending order); equal rows follow one another, whichever comes first;
* texts of any length count whole;
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Samples of a fingerprint; the standard error of a likeness J is sqrt(J (1 - J) / SAMPLES).
SAMPLES = 64
#: Samples that one generated piece of code makes.
BLOCK = 8
#: Hex digits of a sample in the fingerprint.
DIGITS = 4
#: Ranges that the documents are dealt into, at most, and documents in each, about (more where there are over 25 million documents).
RANGES, RANGE_ROWS = 100_000, 250
#: Ranges of one id's rows.
_WITHIN = 1 << 20
_LOW = (1 << 31) - 1


def sample(term: Column, lnw: Column, number: Column, k: int) -> Column:
    """Sample ``number`` (and k, its place in a block) of a term with log-weight lnw: 31 bits that order as ln a, then 31 of hash(term, t).

    Five 21-bit uniforms come from two 64-bit hashes. No branch stands around the draws, so common parts are evaluated once.
    """
    unit = lambda h, shift: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit((1 << 21) - 1)).cast("double") + 0.5) / F.lit(float(1 << 21))
    h, g = F.xxhash64(term, number, F.lit(2 * k)), F.xxhash64(term, number, F.lit(2 * k + 1))
    r, lnc, beta = -F.ln(unit(h, 0) * unit(h, 21)), F.ln(-F.ln(unit(g, 0) * unit(g, 21))), unit(h, 42)
    t = F.floor(lnw / r + beta)
    lna = lnc - r * (t.cast("double") - beta + 1.0)
    # ln a lies within (-76, 4) for weights up to 10^5; 26 million steps a unit make 31 bits.
    return F.shiftleft(F.floor((lna + 76.0) * 26e6), 31).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit(_LOW)))


def likeness(a: Column, b: Column, count: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints, 0 to 1; computed from the fingerprints alone."""
    same = [(F.substring(a, k * DIGITS + 1, DIGITS) == F.substring(b, k * DIGITS + 1, DIGITS)).cast("int") for k in range(count)]
    return reduce(lambda x, y: x + y, same).cast("double") / count


def _hex(minimum: Column) -> Column:
    return F.lpad(F.lower(F.hex(minimum.bitwiseAND(F.lit(_LOW)) % (16**DIGITS - 1) + 1)), DIGITS, "0")


def _longs(values: list[int]) -> Column:
    """An array of longs as one folded literal, however many there are."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def _place(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the bounds, ascending, are at or over an id: its range, descending. Looked up in two steps of about sqrt(n)."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    tops = _longs([bounds[min(i + step, len(bounds)) - 1] for i in range(0, len(bounds), step)])
    below = F.size(F.filter(tops, lambda b: b < doc_id))
    inner = F.size(F.filter(F.slice(_longs(bounds), below * step + 1, F.lit(step)), lambda b: b < doc_id))
    return F.greatest(F.lit(len(bounds)) - below * step - inner, F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """(_range, _pos, doc_id, text, next_text): the next document in descending doc_id, after the last the first.

    Ranges of doc_id are cut at quantiles, and a window inside each finds the next row. Rows of one id, and rows without
    one, are ordered by a hash of their text; where an id takes up several quantiles, and for null ids, that hash cuts
    them into as many ranges. For the last row of a range, the first document of the range that follows is laid behind
    it: one more row a range, whose result is dropped.
    """
    d = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known, nameless = d.agg(F.count("doc_id"), F.count(F.lit(1)) - F.count("doc_id")).first()
    cuts = min(RANGES, max(1, known // RANGE_ROWS))
    marks = d.agg(F.percentile_approx("doc_id", [i / cuts for i in range(1, cuts)], 20 * min(cuts, 25_000))).first()[0] if cuts > 1 else None
    times = Counter(marks or [])
    bounds = sorted(times)
    # Ids over the last bound are range 0, null ids the last ranges. Of the range behind a bound, the rows of that very id come first.
    hashed = F.xxhash64(F.coalesce(F.col("text"), F.lit("")).cast("string"))
    within = lambda k: F.least(F.floor((hashed.cast("double") / F.lit(float(1 << 64)) + 0.5) * k), k - 1).cast("long")
    of = _place(F.col("doc_id"), bounds)
    many = [times[b] for b in reversed(bounds)]
    hot = F.coalesce(F.get(_longs(many), of - 1), F.lit(1).cast("long"))
    inside = F.when(F.coalesce(F.get(_longs(bounds[::-1]), of - 1) == F.col("doc_id"), F.lit(False)) & (hot > 1), within(hot)).otherwise(F.when(hot > 1, hot).otherwise(0))
    null_ranges = F.lit(max(1, min(RANGES, nameless // RANGE_ROWS)))
    # Stated as never null: a null test on one use of the ranges would keep Spark from reusing the shuffle for the other.
    # Texts are only looked at for ranges where they matter.
    by_id = of.cast("long") * _WITHIN
    if any(k > 1 for k in many):
        by_id = by_id + inside
    if nameless:
        last = F.lit((len(bounds) + 1) * _WITHIN).cast("long")
        by_id = F.when(F.col("doc_id").isNull(), last + within(null_ranges) if nameless >= 2 * RANGE_ROWS else last).otherwise(by_id)
    place = F.coalesce(by_id, F.lit(0).cast("long"))
    d = d.withColumn("_range", place)
    only_ids = nameless < 2 * RANGE_ROWS and not any(k > 1 for k in many)
    first = (docs.select("doc_id") if only_ids else docs.select("doc_id", F.col("text").cast("string").alias("text"))).withColumn("_range", place)
    first = materialize(first.groupBy("_range").agg(F.max("doc_id").alias("_top")), "cws-ranges")
    ring = Window.orderBy("_range")
    before = first.withColumn("_of", F.coalesce(F.lag("_range").over(ring), F.max("_range").over(Window.partitionBy(F.lit(1))))).withColumnRenamed("_range", "_mine")
    heads = d.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("_top")) & (F.col("_range") == F.col("_mine")))
    heads = heads.groupBy("_of").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    d = d.withColumn("_head", F.lit(0)).unionByName(heads.select(F.lit(None).cast(d.schema["doc_id"].dataType).alias("doc_id"), "text", F.coalesce("_of", F.lit(0).cast("long")).alias("_range"), F.lit(1).alias("_head")))
    d = d.withColumn("_h", F.xxhash64("text"))
    down = Window.partitionBy("_range").orderBy("_head", F.col("doc_id").desc_nulls_last(), "_h", "text")
    d = d.withColumn("_pos", F.row_number().over(down)).withColumn("next_text", F.lead("text").over(down)).where("_head = 0")
    return d.select("_range", "_pos", "doc_id", "text", "next_text")


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n / 3) code points replaced by the first as many (or all) of the following text."""
    n = F.length(text)
    cut = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_pairs(docs: DataFrame, count: int = SAMPLES, block: int = BLOCK) -> DataFrame:
    """(_range, _pos, fingerprint, edited_fingerprint) of docs(_range, _pos, a, b) with words; two texts share their words' draws.

    A word that both texts hold equally often is one row for both, and every row makes count / block rows of ``block``
    samples each, which keeps the generated code small enough to be compiled well.
    """
    row = ["_range", "_pos"]
    text = docs.select(*row, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("text")), F.struct(F.lit(1).alias("side"), F.col("b").alias("text")))).alias("x"))
    word = text.select(*row, "x.side", F.explode(F.split(F.lower("x.text"), r"[\x20\x09-\x0D]+")).alias("word")).where("word <> ''")
    t = word.groupBy(*row, F.xxhash64("word").alias("h")).agg(F.sum(1 - F.col("side")).alias("wa"), F.sum("side").alias("wb"))
    pair = lambda side, w: F.struct(F.lit(side).alias("side"), w.alias("w"))
    each = F.when(F.col("wa") == F.col("wb"), F.array(pair(2, F.col("wa")))).otherwise(F.array(pair(0, F.col("wa")), pair(1, F.col("wb"))))
    t = t.select(*row, "h", F.explode(each).alias("x")).where("x.w > 0").select(*row, "h", "x.side", F.ln(F.col("x.w").cast("double")).alias("lnw"))
    t = t.select(*row, "side", "h", "lnw", F.explode(F.array(*[F.lit(i) for i in range(count // block)])).alias("part"))
    t = t.groupBy(*row, "side", "part").agg(*[F.min(sample(F.col("h"), F.col("lnw"), F.col("part"), k)).alias(f"m{k}") for k in range(block)])
    # The three kinds of words of a document to its two texts, then blocks to one string.
    t = t.select(*row, "part", F.explode(F.when(F.col("side") == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array("side"))).alias("side"), *[f"m{k}" for k in range(block)])
    t = t.groupBy(*row, "side", "part").agg(*[F.min(f"m{k}").alias(f"m{k}") for k in range(block)])
    t = t.select(*row, "side", "part", F.concat(*[_hex(F.col(f"m{k}")) for k in range(block)]).alias("hex"))
    parts = lambda side: F.concat(*[F.max(F.when((F.col("side") == side) & (F.col("part") == i), F.col("hex"))) for i in range(count // block)])
    return t.groupBy(*row).agg(parts(0).alias("fingerprint"), parts(1).alias("edited_fingerprint"))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness to each other and to the next document's."""
    d = with_next(table(spark, sf_dir, "documents"))
    d = d.select("_range", "_pos", "doc_id", F.col("text").alias("a"), edited(F.col("text"), F.col("next_text")).alias("b"))
    facts = d.select("_range", "_pos", "doc_id", F.length("a").cast("long").alias("n_chars"), F.sha2("b", 256).alias("edited_sha256"))
    empty = F.lit("0" * DIGITS * SAMPLES)
    out = facts.join(fingerprint_pairs(d), ["_range", "_pos"], "left")
    out = materialize(out.withColumns({c: F.coalesce(c, empty) for c in ("fingerprint", "edited_fingerprint")}), "cws")
    down = Window.partitionBy("_range").orderBy("_pos")
    heads = out.where("_pos = 1").select("_range", F.col("fingerprint").alias("_head"))
    ring = Window.orderBy("_range")
    heads = heads.withColumn("_of", F.coalesce(F.lag("_range").over(ring), F.max("_range").over(Window.partitionBy(F.lit(1))))).select("_of", "_head")
    out = out.withColumn("_next", F.lead("fingerprint").over(down))
    out = out.withColumn("_of", F.when(F.col("_next").isNull(), F.col("_range"))).join(F.broadcast(heads), "_of", "left")
    following = F.coalesce("_next", "_head")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), following).alias("near_next"))
