"""Operator 10: mix sources to target weights by Sainte-Lague apportionment.

The corpus is counted in blocks of equal token count. Sources get blocks by
highest quotients (divisors 1, 3, 5, ...) of their targets; each source's blocks
are apportioned in the same way to its shards, so every shard has an integer
quota. Inside a shard, documents lie in a seeded order and form one stream of
words; the quota's words take whole passes of the stream and then its beginning.
A block has 16 words, or fewer where the least target would not make eight of them
(down to one word), so tiny sources and tiny corpora are mixed as well. Shards are
independent: what is ever gathered by source are the totals of its shards (MAX_SHARDS
at most; beyond that shards grow), and by the whole corpus those of its sources, which
one task ranks. Equal rows are counted first and laid out in closed form, so copies
and rows without an id load no task.

Only DataFrame functions are used. Defined cases:

* null or blank text has size 0 and takes 0; a null source is a source of its own, last in order; texts of any length are
  counted whole;
* ``doc_id`` may be null or repeated: each row counts and is returned once;
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import COPIES, WORD, expanded, materialize, small, table

#: Tokens of a block, and documents of a shard on average.
BLOCK_TOKENS, SHARD_ROWS = 16, 1000
#: Shards of a source, at most, and blocks that the least target makes, where blocks can be smaller.
MAX_SHARDS, LEAST_BLOCKS = 20_000, 8
#: No source and no document is taken more than this many times.
MAX_REPEATS = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Add ``target`` to (source, source_size, ...).

    Weights are 1, 2, 3, repeating by source name (code points, null last). The
    shares are water-filled in closed form: in the order of cap / weight, the
    level of the open sources follows from running sums, and the first source
    that this level does not lift over its cap sets it.
    """
    every = Window.partitionBy(F.lit(1))
    name = (F.col("source").isNull(), F.col("source"))
    s = sources.withColumn("_w", (F.row_number().over(Window.orderBy(*name)) - 1) % 3 + 1).withColumn("_cap", max_repeats * F.col("source_size"))
    by_cap = Window.orderBy(F.col("_cap") / F.col("_w"), *name)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_place", F.row_number().over(by_cap))
    s = s.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    s = s.withColumn("_first", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_place"))).over(every))
    s = s.withColumn("_level", F.max(F.when(F.col("_place") == F.col("_first"), F.col("_level"))).over(every))
    s = s.withColumn("target", F.when(F.col("_place") >= F.col("_first"), F.col("_level") * F.col("_w")).otherwise(F.col("_cap").cast("double")))
    return s.drop("_w", "_cap", "_place", "_level", "_first")


def sainte_lague(parties: DataFrame, group: list[str], party: list[Column], votes: str, seats: str, out: str) -> DataFrame:
    """Add the seats won by highest quotients votes / (2 k + 1), ties by party order, within each group.

    With m parties, V votes and N seats, rounding the votes over the divisor
    V / (N - m / 2) gives at most N seats and over V / (N + m / 2) at least N, so
    only the quotients between the two, at most 2 m in all, need ranking.
    """
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    p = parties.withColumn("_m", F.count(F.lit(1)).over(w) / 2.0).withColumn("_v", F.sum(F.col(votes).cast("double")).over(w))
    share = lambda n: F.when(F.col(votes) > 0, F.floor(F.col(votes).cast("double") * F.greatest(n, F.lit(0.0)) / F.col("_v") + 0.5)).otherwise(0).cast("long")
    p = p.withColumn("_lo", share(F.col(seats).cast("double") - F.col("_m"))).withColumn("_hi", share(F.col(seats).cast("double") + F.col("_m")))
    p = p.withColumn("_open", F.col(seats) - F.sum("_lo").over(w))
    q = p.withColumn("_k", F.explode_outer(F.when(F.col("_hi") > F.col("_lo"), F.sequence(F.col("_lo"), F.col("_hi") - 1))))
    rank = F.row_number().over(w.orderBy(F.col("_k").isNull(), (F.col(votes).cast("double") / (2 * F.col("_k") + 1)).desc(), *party))
    q = q.withColumn("_won", (F.col("_k").isNotNull() & (rank <= F.col("_open"))).cast("long"))
    return q.groupBy(*parties.columns, "_lo").agg(F.sum("_won").alias("_won")).withColumn(out, F.col("_lo") + F.col("_won")).drop("_lo", "_won")


def mix(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every row of docs(doc_id, source, text)."""
    words = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    d = materialize(words.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("_copies")).withColumn("_key", key), "mix")
    sources = d.groupBy("source").agg(F.sum(F.col("size") * F.col("_copies")).alias("source_size"), F.least(F.ceil(F.sum("_copies") / shard_rows), F.lit(MAX_SHARDS)).cast("long").alias("_shards"))
    sources = source_targets(sources, max_repeats)
    every = Window.partitionBy(F.lit(1))
    least = F.min(F.when(F.col("source_size") > 0, F.col("target"))).over(every)
    sources = sources.withColumn("_block", F.coalesce(F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(least / LEAST_BLOCKS))), F.lit(1)).cast("long"))
    sources = sources.withColumn("_n", F.round(F.sum("source_size").over(every).cast("double") / F.col("_block")).cast("long"))
    sources = sainte_lague(sources, [], [F.col("source").isNull(), F.col("source")], "target", "_n", "_quota").drop("_n")
    sources = materialize(sources.withColumnRenamed("source", "_source"), "mix-sources")
    d = d.join(small(sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("_shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_shards")).drop("_shards")
    place = [F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("_s"), F.col("_shard")]
    whole = F.col("size") * F.col("_copies")
    shards = d.groupBy(*place).agg(F.sum(whole).alias("_shard_size"), F.first("_quota").alias("_quota"), F.first("_block").alias("_block"))
    shards = sainte_lague(shards, ["_s"], [F.col("_shard")], "_shard_size", "_quota", "_blocks").drop("_quota")
    shards = shards.withColumn("_words", F.col("_blocks") * F.col("_block")).drop("_blocks", "_block")
    d = d.drop("_quota", "_block").withColumn("_s", place[0])
    stream = Window.partitionBy("_s", "_shard").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_start", F.coalesce(F.sum(whole).over(stream), F.lit(0)))
    d = d.join(small(materialize(shards, "mix-shards")), ["_s", "_shard"])
    passes = F.least(F.floor(F.col("_words") / F.greatest("_shard_size", F.lit(1))), F.lit(max_repeats))
    rest = F.when(passes < max_repeats, F.col("_words") - passes * F.col("_shard_size")).otherwise(0)
    kept = ["doc_id", "source", "size", "source_size", "target"]
    d = d.select(*kept, "_copies", "_start", passes.alias("_passes"), rest.alias("_rest"))
    # Copies of a row lie one behind the other in the stream.
    d = expanded(d, "_copies", COPIES)
    begin = F.col("_start") + F.col("_copy") * F.col("size")
    taken = F.col("_passes") * F.col("size") + F.least(F.greatest(F.col("_rest") - begin, F.lit(0)), F.col("size"))
    return d.select(*kept, taken.cast("long").alias("taken"))


def take(docs: DataFrame, **parameters) -> DataFrame:
    """docs as the mix takes them: each document taken / size times, to the nearest whole number.

    Only the document at the end of a shard's quota is taken in part, so sources stay near their targets. Documents
    without words have nothing to take and are left out. Rows with one id are taken equally often; rows without an id
    get keys of their own, which are stored, so every use of them sees the same.
    """
    named = docs.where("doc_id is not null").withColumn("__row", F.col("doc_id").cast("string"))
    nameless = docs.where("doc_id is null").withColumn("__row", F.concat(F.lit("null:"), F.monotonically_increasing_id().cast("string")))
    rows = named.unionByName(materialize(nameless, "mix-nameless"))
    mixed = mix(rows.select(F.col("__row").alias("doc_id"), "source", "text"), **parameters).groupBy("doc_id").agg(F.sum("taken").alias("_taken"), F.sum("size").alias("_size"))
    times = materialize(mixed.select(F.col("doc_id").alias("__taken"), F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + 0.5)).otherwise(0).cast("int").alias("__times")).where("__times > 0"), "mix-times")
    out = rows.join(small(times), F.col("__row") == F.col("__taken"))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, under the corpus's own mix; the cases are those of mix()."""
    return mix(table(spark, sf_dir, "documents")).drop("source")


def _apportion(parties: str, group: str, party: str, votes: str, seats: str, keep: str, out: str) -> str:
    by = f"PARTITION BY {group}" if group else ""
    return f"""
  {out}_p AS (SELECT *, count(*) OVER ({by}) / 2e0 AS m, sum(CAST({votes} AS DOUBLE)) OVER ({by}) AS v FROM {parties}),
  {out}_q AS (SELECT *, CASE WHEN {votes} > 0 THEN CAST(floor(CAST({votes} AS DOUBLE) * greatest({seats} - m, 0e0) / v + 0.5e0) AS BIGINT) ELSE 0 END AS lo,
                        CASE WHEN {votes} > 0 THEN CAST(floor(CAST({votes} AS DOUBLE) * greatest({seats} + m, 0e0) / v + 0.5e0) AS BIGINT) ELSE 0 END AS hi FROM {out}_p),
  {out}_r AS (SELECT *, {seats} - sum(lo) OVER ({by}) AS open FROM {out}_q),
  {out}_k AS (SELECT *, unnest(CASE WHEN hi > lo THEN range(lo, hi) ELSE [NULL] END) AS k FROM {out}_r),
  {out}_w AS (SELECT *, CASE WHEN k IS NOT NULL AND row_number() OVER ({by} ORDER BY k IS NULL, CAST({votes} AS DOUBLE) / (2 * k + 1) DESC, {party}) <= open THEN 1 ELSE 0 END AS won FROM {out}_k),
  {out} AS (SELECT {keep}, CAST(lo + sum(won) AS BIGINT) AS won FROM {out}_w GROUP BY {keep}, lo)"""


def oracle(documents: str = "documents", block_tokens: int = BLOCK_TOKENS, shard_rows: int = SHARD_ROWS, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> str:
    """DuckDB SQL for mix(), as (doc_id, size, source_size, target, taken)."""
    return rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS k0 FROM {documents}),
  s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, least(CAST(ceil(count(*) / CAST({shard_rows} AS DOUBLE)) AS BIGINT), {MAX_SHARDS}) AS shards FROM d GROUP BY source),
  s1 AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, {max_repeats} * source_size AS cap, source IS NULL AS sn FROM s0),
  s2 AS (SELECT *, row_number() OVER (ORDER BY cap / CAST(w AS DOUBLE), sn, source) AS place,
                CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / CAST(w AS DOUBLE), sn, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / CAST(w AS DOUBLE), sn, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lev FROM s1),
  s3 AS (SELECT *, min(CASE WHEN lev * w <= cap THEN place END) OVER () AS fst FROM s2),
  s4 AS (SELECT *, max(CASE WHEN place = fst THEN lev END) OVER () AS lam FROM s3),
  s45 AS (SELECT source, sn, source_size, shards, CASE WHEN place >= fst THEN lam * w ELSE CAST(cap AS DOUBLE) END AS target FROM s4),
  s46 AS (SELECT *, coalesce(greatest(1, least({block_tokens}, CAST(floor(min(CASE WHEN source_size > 0 THEN target END) OVER () / {LEAST_BLOCKS}) AS BIGINT))), 1) AS b FROM s45),
  s5 AS (SELECT *, CAST(round(CAST(sum(source_size) OVER () AS DOUBLE) / b) AS BIGINT) AS n FROM s46),
  {_apportion("s5", "", "sn, source", "target", "n", "source, source_size, shards, target, b", "s6").strip()},
  e AS (SELECT d.*, s6.source_size, s6.target, s6.b, s6.won AS quota, CAST('0x' || substr(k0, 1, 8) AS BIGINT) % shards AS shard, coalesce('s' || d.source, 'n') AS sk
        FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source),
  h0 AS (SELECT sk, shard, CAST(sum(size) AS BIGINT) AS ss, any_value(quota) AS quota, any_value(b) AS b FROM e GROUP BY sk, shard),
  {_apportion("h0", "sk", "shard", "ss", "quota", "sk, shard, ss, b", "h1").strip()},
  f AS (SELECT e.*, ss, won * h1.b AS words, coalesce(sum(size) OVER (PARTITION BY e.sk, e.shard ORDER BY k0, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st
        FROM e JOIN h1 ON e.sk = h1.sk AND e.shard = h1.shard),
  g AS (SELECT *, least(CAST(floor(words / CAST(greatest(ss, 1) AS DOUBLE)) AS BIGINT), {max_repeats}) AS ps FROM f)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(ps * size + least(greatest(CASE WHEN ps < {max_repeats} THEN words - ps * ss ELSE 0 END - st, 0), size) AS BIGINT) AS taken FROM g"""
