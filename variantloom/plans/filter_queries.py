"""Queries on filters, joins and units (F, J, W, O), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters as L
from ..operators import stats as S
from ..operators import units as U
from ..sources.fixture import CUBE, load
from .base import add
from .stats_queries import AF0, COUNTS, MISS, fold

_V = "SELECT variant_index, variant_id FROM variants"


def _v(ds):
    return ds.variants.select("variant_index", "variant_id")


def _frame(s, sql: str):
    return s.sql(sql)


add("f1_filter_both", lambda s, d: S.allele_freq(L.by_sample_id(L.by_flag(load(s, d), F.col("num_allele") == 2), load(s, d).samples.where("sex = 'F'").select("sample_id"))),
    CUBE + ", sel AS (SELECT * FROM samples WHERE sex = 'F'), n AS (SELECT COUNT(*) AS ns FROM sel), c AS (SELECT calls.* FROM calls SEMI JOIN sel ON calls.sample_index = sel.sample_index)"
    " SELECT v.variant_index, CAST(2 * MAX(ns) - 2 * COUNT(c.variant_index) + COALESCE(SUM((a1 = 0)::INT), 0) + COALESCE(SUM((a2 = 0)::INT), 0) AS DOUBLE) / NULLIF(CAST(2 * MAX(ns) - SUM((c.variant_index IS NOT NULL AND a1 IS NULL)::INT + (c.variant_index IS NOT NULL AND a2 IS NULL)::INT) AS DOUBLE), 0e0) AS af"
    " FROM variants v CROSS JOIN n LEFT JOIN c ON c.variant_index = v.variant_index WHERE num_allele = 2 GROUP BY v.variant_index")
add("f2_samples_by_id", lambda s, d: L.by_sample_id(load(s, d), ["Supplier#000000001", "Supplier#000000003", None, "none"]).samples.select("sample_index", "sample_id"), CUBE + "SELECT sample_index, sample_id FROM samples WHERE sample_id IN ('Supplier#000000001', 'Supplier#000000003')")
add("f3_samples_by_index", lambda s, d: L.by_index(load(s, d), [3, 1, 3, None], "sample").samples.select("sample_index", "sample_id"), CUBE + "SELECT sample_index, sample_id FROM samples WHERE sample_index IN (1, 3)")
add("f5_variants_by_flag", lambda s, d: _v(L.by_flag(load(s, d), F.col("qual") > 56.5)), CUBE + _V + " WHERE qual > 56.5e0")
add("f5_variants_by_index", lambda s, d: _v(L.by_index(load(s, d), [2, 5, 5, 7])), CUBE + _V + " WHERE variant_index IN (2, 5, 7)")
add("f6_intersect_index", lambda s, d: _v(L.by_index(L.by_flag(load(s, d), F.col("num_allele") > 2), range(1, 12), intersect=True)), CUBE + ", r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY variant_index) AS n FROM variants WHERE num_allele > 2) SELECT variant_index, variant_id FROM r WHERE n <= 11")


def _stack(s, d):
    f = L.FilterStack(load(s, d))
    f.set(L.by_chromosome(f.current, ["1", "2", "X"]))
    f.push()
    f.set(L.by_flag(f.current, F.col("num_allele") == 2))
    deep = _v(f.current).withColumn("level", F.lit(2))
    f.pop()
    return deep.unionByName(_v(f.current).withColumn("level", F.lit(1)))


add("f7_filter_stack", _stack, CUBE + "SELECT variant_index, variant_id, 2 AS level FROM variants WHERE chromosome IN ('1', '2', 'X') AND num_allele = 2 UNION ALL SELECT variant_index, variant_id, 1 AS level FROM variants WHERE chromosome IN ('1', '2', 'X')")


def _requested(s, d):
    ds = load(s, d)
    q = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("request_ix"), (F.col("o_custkey") + 1).alias("variant_id"))
    chosen = L.by_variant_id(ds, q.select("variant_id")).variants.select("variant_id", "variant_index")
    return L.index_of_requested(q, chosen, "variant_id")


add("f4_variants_by_id", lambda s, d: _v(L.by_variant_id(load(s, d), s.read.parquet(f"{d}/orders.parquet").select((F.col("o_orderkey") + 1).alias("i")))), CUBE + _V + " WHERE variant_id IN (SELECT o_orderkey + 1 FROM orders)")
add("f8_request_index", lambda s, d: _requested(s, d), CUBE + ", q AS (SELECT o_orderkey AS request_ix, o_custkey + 1 AS variant_id FROM orders), sel AS (SELECT variant_id, ROW_NUMBER() OVER (ORDER BY variant_index) AS place FROM variants WHERE variant_id IN (SELECT variant_id FROM q)) SELECT q.request_ix, CAST(sel.place AS BIGINT) AS place FROM q LEFT JOIN sel ON sel.variant_id = q.variant_id")


add("f9_reset", lambda s, d: _v(L.FilterStack(L.by_flag(load(s, d), F.lit(True))).reset()), CUBE + _V)
add("f10_chromosomes", lambda s, d: _v(L.by_chromosome(load(s, d), ["X", "7"])), CUBE + _V + " WHERE chromosome IN ('X', '7')")
add("f10_numeric_chromosomes", lambda s, d: _v(L.by_chromosome(load(s, d), is_num=True)), CUBE + _V + " WHERE regexp_full_match(chromosome, '[0-9]+')")
add("f10_chromosome_ranges", lambda s, d: _v(L.by_chromosome(load(s, d), ["1", "1", "2", "Y"], from_bp=[1000, 3000, None, 5000], to_bp=[3500, 4000, 2500, 100])), CUBE + _V + " WHERE (chromosome = '1' AND position BETWEEN 1000 AND 4000) OR (chromosome = '2' AND position <= 2500) OR (chromosome = 'Y' AND position = 5000)")
add("f11_ranges", lambda s, d: _v(L.by_ranges(load(s, d), [("chr3", 1000, 2250), ("chrX", 2250, 6000), ("chr3", 2251, 3500)])), CUBE + _V + " WHERE (chromosome = '3' AND position BETWEEN 1000 AND 3500) OR (chromosome = 'X' AND position BETWEEN 2250 AND 6000)")


def _ranges(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(((F.col("c_custkey") % 22) + 1).cast("string").alias("chromosome"), (F.col("c_custkey") * 37 + 1000).alias("lo"), (F.col("c_custkey") * 37 + 1000 + F.col("c_custkey") % 90).alias("hi"))


_RANGES = ", r AS (SELECT CAST(c_custkey % 22 + 1 AS VARCHAR) AS rc, c_custkey * 37 + 1000 AS lo, c_custkey * 37 + 1000 + c_custkey % 90 AS hi FROM customer)"
add("j2_range_join", lambda s, d: _v(L.by_ranges(load(s, d), _ranges(s, d), strip=None)), CUBE + _RANGES + " " + _V + " v WHERE EXISTS (SELECT 1 FROM r WHERE rc = v.chromosome AND v.position BETWEEN lo AND hi)")


def _queries(s, d):
    """Positions from orders, some with alleles, some with wildcards, with repeats and misses."""
    k = F.col("o_custkey")
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.col("o_orderkey").alias("query_ix"), F.when(k % 24 == 22, "X").when(k % 24 == 23, "Y").otherwise(((k % 24) + 1).cast("string")).alias("chromosome"), (1000 + (k % 30) * 1250).cast("int").alias("position"), F.when(k % 3 == 0, "T").when(k % 3 == 1, "G").alias("ref"), F.when(k % 2 == 0, F.when(k % 3 == 0, "C,G").otherwise("A")).alias("alt"))


_Q = """, q AS (SELECT o_orderkey AS query_ix, CASE WHEN o_custkey % 24 = 22 THEN 'X' WHEN o_custkey % 24 = 23 THEN 'Y' ELSE CAST(o_custkey % 24 + 1 AS VARCHAR) END AS qc, CAST(1000 + (o_custkey % 30) * 1250 AS INT) AS qp,
  CASE WHEN o_custkey % 3 = 0 THEN 'T' WHEN o_custkey % 3 = 1 THEN 'G' END AS qr, CASE WHEN o_custkey % 2 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'C,G' ELSE 'A' END END AS qa FROM orders),
 m AS (SELECT query_ix, variant_index FROM q LEFT JOIN variants v ON qc = chromosome AND qp = position AND (qr IS NULL OR qr = split_part(allele, ',', 1)) AND (qa IS NULL OR (strpos(allele, ',') > 0 AND qa = substr(allele, strpos(allele, ',') + 1))))
"""
add("j1_position_matches", lambda s, d: L.match_positions(load(s, d).variants, _queries(s, d)), CUBE + _Q + "SELECT query_ix, variant_index FROM m")
add("f12_positions", lambda s, d: _v(L.by_positions(load(s, d), _queries(s, d))), CUBE + _Q + _V + " WHERE variant_index IN (SELECT variant_index FROM m)")
add("f12_positions_first", lambda s, d: _v(L.by_positions(load(s, d), _queries(s, d), multi=False)), CUBE + _Q + _V + " WHERE variant_index IN (SELECT MIN(variant_index) FROM m GROUP BY query_ix)")
add("f12_positions_no_alleles", lambda s, d: _v(L.by_positions(load(s, d), _queries(s, d).drop("ref", "alt"))), CUBE + _Q + _V + " v WHERE EXISTS (SELECT 1 FROM q WHERE qc = v.chromosome AND qp = v.position)")
add("f12_position_index", lambda s, d: L.position_index(load(s, d), _queries(s, d)), CUBE + _Q + ", r AS (SELECT variant_index, ROW_NUMBER() OVER (ORDER BY variant_index) AS place FROM (SELECT DISTINCT variant_index FROM m WHERE variant_index IS NOT NULL)), f AS (SELECT query_ix, MIN(variant_index) AS variant_index FROM m GROUP BY query_ix) SELECT f.query_ix, CAST(r.place AS BIGINT) AS place FROM f LEFT JOIN r ON r.variant_index = f.variant_index")
add("f13_annotation_ids", lambda s, d: _v(L.by_annotation_id(load(s, d), L.by_chromosome(load(s, d), ["1"]), ["rs5", "rs17", "rs100", None])), CUBE + _V + " WHERE id IN ('rs5', 'rs17', 'rs100')")
_MAF, _MAC = fold(AF0), "CASE WHEN tot > nm THEN least(n0, tot - nm - n0) END"
add("f14_condition_default", lambda s, d: _v(L.by_condition(load(s, d))), CUBE + COUNTS + f"SELECT k.variant_index, variant_id FROM k JOIN variants v ON v.variant_index = k.variant_index WHERE {_MAC} >= 1")
add("f14_condition", lambda s, d: _v(L.by_condition(load(s, d), maf=(0.01, 0.2), mac=(2, 40), missing_rate=0.05)), CUBE + COUNTS + f"SELECT k.variant_index, variant_id FROM k JOIN variants v ON v.variant_index = k.variant_index WHERE {_MAF} >= 0.01e0 AND {_MAF} < 0.2e0 AND {_MAC} >= 2 AND {_MAC} < 40 AND {MISS} <= 0.05e0")
add("f15_flags", lambda s, d: L.flags(load(s, d), L.by_chromosome(load(s, d), ["5"])), CUBE + "SELECT variant_index, chromosome = '5' AS selected FROM variants")
add("f16_split_parts", lambda s, d: L.split(load(s, d).variants, parts=7).groupBy("part").agg(F.min("variant_index").alias("lo"), F.max("variant_index").alias("hi")), CUBE + ", n AS (SELECT COUNT(*) AS n FROM variants), e AS (SELECT i, CAST(round_even(i * n / 7e0, 0) AS INT) AS e, CAST(round_even((i - 1) * n / 7e0, 0) AS INT) AS b FROM n, range(1, 8) t(i)) SELECT CAST(i AS INT) AS part, CAST(b + 1 AS INT) AS lo, e AS hi FROM e")
add("f16_split_blocks", lambda s, d: L.split(load(s, d).variants, block=64).groupBy("part").agg(F.min("variant_index").alias("lo"), F.max("variant_index").alias("hi")), CUBE + "SELECT CAST(floor((variant_index - 1) / 64e0) + 1 AS INT) AS part, MIN(variant_index) AS lo, MAX(variant_index) AS hi FROM variants GROUP BY 1")
add("j3_id_semi_join", lambda s, d: _v(L.by_variant_id(load(s, d), s.read.parquet(f"{d}/lineitem.parquet").where("l_quantity > 49").select((F.col("l_partkey") + 1).alias("i")))), CUBE + _V + " WHERE variant_id IN (SELECT l_partkey + 1 FROM lineitem WHERE l_quantity > 49)")
add("o1_file_order", lambda s, d: L.numbered(L.by_flag(load(s, d), F.col("num_allele") == 3).variants.select("variant_index"), "variant_index").select("variant_index", F.col("_rank").alias("rank")), CUBE + "SELECT variant_index, ROW_NUMBER() OVER (ORDER BY variant_index) AS rank FROM variants WHERE num_allele = 3")
add("o4_row_slice", lambda s, d: _v(L.by_index(load(s, d), range(11, 31))), CUBE + _V + " WHERE variant_index BETWEEN 11 AND 30")

_W = """, e AS (SELECT chromosome, variant_index, unnest(range(CAST(greatest(floor((position - {size}) / {shift}e0) + 1, 0) AS BIGINT), CAST(floor(position / {shift}e0) AS BIGINT) + 1)) AS k FROM variants),
 w AS (SELECT chromosome, k, array_to_string(list_sort(list(variant_index)), ',') AS ix, COUNT(*) AS n FROM e GROUP BY chromosome, k),
 u AS (SELECT *, lag(ix) OVER (PARTITION BY chromosome ORDER BY k) AS prev FROM w)
"""


def _units(s, d, **k):
    return U.sliding_windows(load(s, d).variants, **k)


def _ux():
    return F.array_join(F.transform("index", lambda x: x.cast("string")), ",").alias("index")


add("w1_sliding_windows", lambda s, d: _units(s, d).select("chromosome", "start", "end", _ux()), CUBE + _W.format(size=5000, shift=2500) + 'SELECT chromosome, CAST(k * 2500 AS INT) AS start, CAST(k * 2500 + 4999 AS INT) AS "end", ix AS index FROM u WHERE prev IS NULL OR prev <> ix')
add("w1_sparse_windows", lambda s, d: _units(s, d, size=1000, shift=3000).select("chromosome", "start", "end", _ux()), CUBE + _W.format(size=1000, shift=3000) + 'SELECT chromosome, CAST(k * 3000 AS INT) AS start, CAST(k * 3000 + 999 AS INT) AS "end", ix AS index FROM u WHERE prev IS NULL OR prev <> ix')
add("w1_all_windows", lambda s, d: _units(s, d, dup_rm=False).select("chromosome", "start", "end", F.size("index").alias("n")), CUBE + _W.format(size=5000, shift=2500) + ', t AS (SELECT chromosome, MAX(position) AS top FROM variants GROUP BY chromosome), g AS (SELECT chromosome, unnest(range(0, CAST(greatest(floor((top - 5000 + 2500) / 2500e0), 0) AS BIGINT) + 1)) AS k FROM t) SELECT g.chromosome, CAST(g.k * 2500 AS INT) AS start, CAST(g.k * 2500 + 4999 AS INT) AS "end", CAST(COALESCE(w.n, 0) AS INT) AS n FROM g LEFT JOIN w ON w.chromosome = g.chromosome AND w.k = g.k')
add("w2_create_units", lambda s, d: U.create(s, [[1, None, 3], [0, -1, 5], []], ["1", "2", "3"]).select("unit_ix", "chromosome", _ux()), "SELECT * FROM (VALUES (CAST(1 AS BIGINT), '1', '1,3'), (2, '2', '5'), (3, '3', '')) t(unit_ix, chromosome, index)")
_NUM = 'n AS (SELECT *, ROW_NUMBER() OVER (ORDER BY first, k) AS unit_ix FROM (SELECT u.*, (SELECT MIN(variant_index) FROM variants v WHERE v.chromosome = u.chromosome) AS first FROM u WHERE prev IS NULL OR prev <> ix))'
add("w3_subset_units", lambda s, d: U.subset(U.number_units(_units(s, d), load(s, d).variants), [2, 4, 9]).select("unit_ix", "chromosome", "start"), CUBE + _W.format(size=5000, shift=2500) + ", " + _NUM + " SELECT CAST(unit_ix AS BIGINT) AS unit_ix, chromosome, CAST(k * 2500 AS INT) AS start FROM n WHERE unit_ix IN (2, 4, 9)")
add("w4_merge_units", lambda s, d: _merged_units(s, d), CUBE + _W.format(size=5000, shift=2500) + ", " + _NUM + ", c AS (SELECT COUNT(*) AS c FROM n) SELECT CAST(unit_ix AS BIGINT) AS unit_ix, CAST(k * 2500 AS INT) AS start FROM n UNION ALL SELECT CAST(unit_ix + c AS BIGINT), CAST(k * 2500 AS INT) FROM n, c")


def _merged_units(s, d):
    u = U.number_units(_units(s, d), load(s, d).variants)
    return U.merge(u, u).select("unit_ix", "start")


add("w5_unit_difference", lambda s, d: U.set_diff(_units(s, d), _units(s, d, size=2500)).select("chromosome", "start", F.size("index").alias("n")), CUBE + _W.format(size=5000, shift=2500) + ", k1 AS (SELECT * FROM u WHERE prev IS NULL OR prev <> ix) SELECT chromosome, CAST(k * 2500 AS INT) AS start, CAST(n AS INT) AS n FROM k1")
add("w6_unit_condition", lambda s, d: U.filter_condition(load(s, d), _units(s, d), maf=0.01, missing_rate=0.05, minsize=2).select("chromosome", "start", _ux()), CUBE + COUNTS + f", good AS (SELECT variant_index FROM k WHERE {_MAF} >= 0.01e0 AND {_MAC} >= 1 AND {MISS} <= 0.05e0)" + _W.format(size=5000, shift=2500) + ", x AS (SELECT chromosome, k, unnest(string_split(ix, ','))::INT AS vi FROM u WHERE prev IS NULL OR prev <> ix) SELECT chromosome, CAST(k * 2500 AS INT) AS start, array_to_string(list_sort(list(vi)), ',') AS index FROM x WHERE vi IN (SELECT variant_index FROM good) GROUP BY chromosome, x.k HAVING COUNT(*) >= 2")
add("w7_unit_apply", lambda s, d: _applied(s, d), CUBE + _W.format(size=5000, shift=2500) + ", x AS (SELECT chromosome, k, unnest(string_split(ix, ','))::INT AS vi FROM u WHERE prev IS NULL OR prev <> ix) SELECT x.chromosome, CAST(k * 2500 AS INT) AS start, CAST(SUM(ac) AS BIGINT) AS total FROM x JOIN variants v ON v.variant_index = vi GROUP BY x.chromosome, k")


def _applied(s, d):
    v = load(s, d).variants
    u = U.number_units(_units(s, d), v)

    def total(key, frame):
        import pandas as pd

        return pd.DataFrame({"unit_ix": [key[0]], "total": [int(frame["ac"].sum())]})

    return U.unit_apply(u, v.select("variant_index", "ac"), total, "unit_ix long, total long").join(u.select("unit_ix", "chromosome", "start"), "unit_ix").select("chromosome", "start", "total")


add("w8_block_apply", lambda s, d: U.block_apply(load(s, d).variants.select("variant_index", "ac"), _block_sum, "block long, first int, total long", 100), CUBE + "SELECT CAST(floor((variant_index - 1) / 100e0) + 1 AS BIGINT) AS block, MIN(variant_index) AS first, CAST(SUM(ac) AS BIGINT) AS total FROM variants GROUP BY 1")


def _block_sum(frame):
    import pandas as pd

    return pd.DataFrame({"block": [frame["block"].iloc[0]], "first": [frame["variant_index"].iloc[0]], "total": [int(frame["ac"].sum())]})


add("a16_unit_summary", lambda s, d: U.unit_stats(_units(s, d)), CUBE + _W.format(size=5000, shift=2500) + ", k1 AS (SELECT * FROM u WHERE prev IS NULL OR prev <> ix) SELECT COUNT(*) AS n_units, avg(n) AS mean, CAST(median(n) AS DOUBLE) AS median, CAST(MIN(n) AS INT) AS min, CAST(MAX(n) AS INT) AS max, stddev_samp(n) AS sd, (SELECT COUNT(DISTINCT variant_index) FROM e) AS n_variants FROM k1")
