"""Queries on projections and aggregations (P, D, A), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import stats as S
from ..operators.get import get, get_text
from ..sources.fixture import CUBE, cube_table, load
from .base import ORACLE_SQL, add

COUNTS = """,
n AS (SELECT CAST(COUNT(*) AS BIGINT) AS ns FROM samples),
cc AS (SELECT variant_index, COUNT(*) AS rec, SUM(CASE WHEN a1 IS NULL THEN 1 ELSE 0 END + CASE WHEN a2 IS NULL THEN 1 ELSE 0 END) AS nm,
              SUM(CASE WHEN a1 = 0 THEN 1 ELSE 0 END + CASE WHEN a2 = 0 THEN 1 ELSE 0 END) AS z,
              SUM(CASE WHEN a1 = 1 THEN 1 ELSE 0 END + CASE WHEN a2 = 1 THEN 1 ELSE 0 END) AS one FROM calls GROUP BY variant_index),
k AS (SELECT v.variant_index, v.num_allele, v.chromosome, v.position, v.allele, v.aa, 2 * ns AS tot, CAST(COALESCE(nm, 0) AS BIGINT) AS nm,
             CAST(2 * ns - 2 * COALESCE(rec, 0) + COALESCE(z, 0) AS BIGINT) AS n0, CAST(COALESCE(one, 0) AS BIGINT) AS n1
      FROM variants v CROSS JOIN n LEFT JOIN cc ON cc.variant_index = v.variant_index)
"""
AF0 = "CAST(n0 AS DOUBLE) / NULLIF(CAST(tot - nm AS DOUBLE), 0e0)"
AF1 = "CAST(n1 AS DOUBLE) / NULLIF(CAST(tot - nm AS DOUBLE), 0e0)"
MISS = "CAST(nm AS DOUBLE) / CAST(tot AS DOUBLE)"


def fold(x: str) -> str:
    return f"CASE WHEN {x} > 0.5e0 THEN 1 - {x} ELSE {x} END"


# Stored variables.
add("p1_samples", lambda s, d: load(s, d).samples.select("sample_index", "sample_id", "family", "sex"), CUBE + "SELECT sample_index, sample_id, family, sex FROM samples")
add("p2_variant_columns", lambda s, d: load(s, d).variants.select("variant_index", "variant_id", "allele", "id", "qual", "filter"), CUBE + "SELECT variant_index, variant_id, allele, id, qual, filter FROM variants")
add("p3_position", lambda s, d: load(s, d).variants.select("variant_index", "position"), CUBE + "SELECT variant_index, position FROM variants")
add("p4_chromosome", lambda s, d: load(s, d).variants.select("variant_index", "chromosome"), CUBE + "SELECT variant_index, chromosome FROM variants")
_DENSE = """, g AS (SELECT v.variant_index, s.sample_index, CASE WHEN c.sample_index IS NULL THEN 0 ELSE a1 END AS a1, CASE WHEN c.sample_index IS NULL THEN 0 ELSE a2 END AS a2,
  COALESCE(phase, FALSE) AS phase, CASE WHEN c.sample_index IS NULL THEN 0e0 ELSE ds END AS ds, c.dp, (c.sample_index IS NOT NULL) AS has
  FROM variants v CROSS JOIN samples s LEFT JOIN calls c ON c.variant_index = v.variant_index AND c.sample_index = s.sample_index)
"""
_TXT = "string_agg(COALESCE(CAST({0} AS VARCHAR), '.'), ',' ORDER BY sample_index)"


add("p5_genotype", lambda s, d: get_text(load(s, d), "genotype").withColumnRenamed("value", "gt"), CUBE + _DENSE + "SELECT variant_index, string_agg(COALESCE(CAST(a1 AS VARCHAR), '.') || ',' || COALESCE(CAST(a2 AS VARCHAR), '.'), ',' ORDER BY sample_index) AS gt FROM g GROUP BY variant_index")
add("p6_genotype_layers", lambda s, d: load(s, d).variants.select("variant_index", C.genotype_layers(C.num_allele(F.col("allele"))).cast("int").alias("layers")), CUBE + "SELECT variant_index, CAST(CASE WHEN num_allele + 1 <= 4 THEN 1 ELSE 2 END AS INT) AS layers FROM variants")
add("p7_phase", lambda s, d: get_text(load(s, d), "phase").withColumnRenamed("value", "phase"), CUBE + _DENSE + f"SELECT variant_index, {_TXT.format('CAST(phase AS INT)')} AS phase FROM g GROUP BY variant_index")
add("p8_info_scalar", lambda s, d: load(s, d).variants.select("variant_index", "aa", "ac"), CUBE + "SELECT variant_index, aa, ac FROM variants")
add("p8_info_array_padded", lambda s, d: load(s, d, info=True).variants.select("variant_index", F.get("bn", F.lit(0)).alias("bn1")), CUBE + "SELECT v.variant_index, b.v AS bn1 FROM variants v LEFT JOIN info_bn b ON b.variant_index = v.variant_index AND b.k = 1")
add("p8_info_list", lambda s, d: load(s, d, info=True).variants.select("variant_index", F.posexplode("bn").alias("k", "value")).select("variant_index", (F.col("k") + 1).alias("k"), "value"), CUBE + "SELECT variant_index, k, v AS value FROM info_bn")
add("p9_info_lengths", lambda s, d: load(s, d, info=True).variants.select("variant_index", F.size("bn").alias("length")), CUBE + "SELECT v.variant_index, CAST(COUNT(b.k) AS INT) AS length FROM variants v LEFT JOIN info_bn b ON b.variant_index = v.variant_index GROUP BY v.variant_index")
add("p10_format_dp", lambda s, d: get_text(load(s, d), "annotation/format/DP").withColumnRenamed("value", "dp"), CUBE + _DENSE + f"SELECT variant_index, {_TXT.format('dp')} AS dp FROM g GROUP BY variant_index")
add("p11_format_lengths", lambda s, d: get(load(s, d), "annotation/format/@DP").withColumnRenamed("value", "length"), CUBE + "SELECT v.variant_index, CAST(COUNT(c.dp) AS INT) AS length FROM variants v LEFT JOIN calls c ON c.variant_index = v.variant_index GROUP BY v.variant_index")
add("p12_external_vector", lambda s, d: _external(s, d), CUBE + "SELECT variant_index, CAST(ac * 2 AS INT) AS score FROM variants WHERE chromosome = '1'")


def _external(s, d):
    ds = load(s, d)
    vector = ds.variants.select("variant_index", (F.col("ac") * 2).cast("int").alias("score"))
    return ds.variants.where("chromosome = '1'").select("variant_index").join(vector, "variant_index")


# Derived columns.
add("d1_chromosome_runs", lambda s, d: C.chromosome_runs(load(s, d).variants), CUBE + """, g AS (SELECT variant_index, chromosome, ROW_NUMBER() OVER (ORDER BY variant_index) - ROW_NUMBER() OVER (PARTITION BY chromosome ORDER BY variant_index) AS g FROM variants),
 r AS (SELECT chromosome, MIN(variant_index) AS lo, COUNT(*) AS length FROM g GROUP BY chromosome, g) SELECT CAST(ROW_NUMBER() OVER (ORDER BY lo) AS INT) AS run, chromosome, CAST(length AS BIGINT) AS length FROM r""")
_DOS = {"d2_dosage": ("dosage", "CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN (a1 = 0)::INT + (a2 = 0)::INT END"), "d3_dosage_alt": ("dosage_alt", "CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN (a1 <> 0)::INT + (a2 <> 0)::INT END"), "d4_dosage_alt2": ("dosage_alt2", "CASE WHEN a1 IS NOT NULL OR a2 IS NOT NULL THEN COALESCE((a1 <> 0)::INT, 0) + COALESCE((a2 <> 0)::INT, 0) END")}
for _name, (_f, _sql) in _DOS.items():
    add(_name, lambda s, d, f=_f: get_text(load(s, d), f"${f}").withColumnRenamed("value", "dosage"), CUBE + _DENSE + f"SELECT variant_index, {_TXT.format(_sql)} AS dosage FROM g GROUP BY variant_index")
add("d5_dosage_sparse", lambda s, d: C.sparse_entries(load(s, d).calls, C.call_dosage_alt(F.col("a1"), F.col("a2"))), CUBE + f", x AS (SELECT sample_index, variant_index, {_DOS['d3_dosage_alt'][1]} AS value FROM calls) SELECT * FROM x WHERE value IS NULL OR value <> 0")
add("d6_dosage_sparse2", lambda s, d: C.sparse_entries(load(s, d).calls, C.call_dosage_alt2(F.col("a1"), F.col("a2"))), CUBE + f", x AS (SELECT sample_index, variant_index, {_DOS['d4_dosage_alt2'][1]} AS value FROM calls) SELECT * FROM x WHERE value IS NULL OR value <> 0")
_ALT = "CASE WHEN strpos(allele, ',') > 0 THEN substr(allele, strpos(allele, ',') + 1) ELSE '' END"
add("d7_num_allele", lambda s, d: load(s, d).variants.select("variant_index", C.num_allele(F.col("allele")).alias("num_allele")), CUBE + "SELECT variant_index, num_allele FROM variants")
add("d8_ref", lambda s, d: load(s, d).variants.select("variant_index", C.ref(F.col("allele")).alias("ref")), CUBE + "SELECT variant_index, split_part(allele, ',', 1) AS ref FROM variants")
add("d9_alt", lambda s, d: load(s, d).variants.select("variant_index", C.alt(F.col("allele")).alias("alt")), CUBE + f"SELECT variant_index, {_ALT} AS alt FROM variants")
add("d10_chrom_pos", lambda s, d: load(s, d).variants.select("variant_index", C.chrom_pos(F.col("chromosome"), F.col("position")).alias("chrom_pos")), CUBE + "SELECT variant_index, chromosome || ':' || position AS chrom_pos FROM variants")
add("d11_chrom_pos2", lambda s, d: C.chrom_pos2(load(s, d).variants).select("variant_index", "chrom_pos2"), CUBE + """, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY chromosome, position ORDER BY variant_index) - 1 AS n FROM variants)
 SELECT variant_index, chromosome || ':' || position || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS chrom_pos2 FROM r""")
add("d12_chrom_pos_allele", lambda s, d: load(s, d).variants.select("variant_index", C.chrom_pos_allele(F.col("chromosome"), F.col("position"), F.col("allele")).alias("key")), CUBE + "SELECT variant_index, chromosome || ':' || position || '_' || replace(allele, ',', '_') AS key FROM variants")
add("d13_sample_index", lambda s, d: load(s, d).samples.where("sex = 'F'").select("sample_index"), CUBE + "SELECT sample_index FROM samples WHERE sex = 'F'")
add("d14_variant_index", lambda s, d: load(s, d).variants.where("num_allele > 2").select("variant_index"), CUBE + "SELECT variant_index FROM variants WHERE num_allele > 2")
add("d15_end_position", lambda s, d: load(s, d).variants.select("variant_index", C.end_position(F.col("position"), F.col("allele")).alias("end_position")), CUBE + "SELECT variant_index, CAST(position + greatest(length(split_part(allele, ',', 1)), 1) - 1 AS INT) AS end_position FROM variants")

# Aggregations over genotypes.
for _dense in (False, True):
    _x = "_dense" if _dense else ""
    add(f"a2_missing_variant{_x}", lambda s, d, x=_dense: S.missing_per_variant(load(s, d).dense() if x else load(s, d), x), CUBE + COUNTS + f"SELECT variant_index, {MISS} AS missing FROM k")
    add(f"a6_allele_freq{_x}", lambda s, d, x=_dense: S.allele_freq(load(s, d).dense() if x else load(s, d), dense=x), CUBE + COUNTS + f"SELECT variant_index, {AF0} AS af FROM k")
    add(f"a11_allele_count{_x}", lambda s, d, x=_dense: S.allele_count(load(s, d).dense() if x else load(s, d), dense=x), CUBE + COUNTS + "SELECT variant_index, CASE WHEN tot > nm THEN n0 END AS ac FROM k")
add("a1_num_allele", lambda s, d: load(s, d).variants.select("variant_index", C.num_allele(F.col("allele")).alias("num_allele")), CUBE + "SELECT variant_index, num_allele FROM variants")
_SM = "SELECT s.sample_index AS {0}, COALESCE(CAST(SUM((c.a1 IS NULL AND c.variant_index IS NOT NULL)::INT + (c.a2 IS NULL AND c.variant_index IS NOT NULL)::INT) AS DOUBLE), 0e0) / (2e0 * (SELECT COUNT(*) FROM variants)) AS missing FROM samples s LEFT JOIN calls c ON c.sample_index = s.sample_index GROUP BY s.sample_index"
add("a3_missing_sample", lambda s, d: S.missing_per_sample(load(s, d)), CUBE + _SM.format("sample_index"))
add("a4_missing_both", lambda s, d: S.missing_both(load(s, d)), CUBE + COUNTS + f"SELECT 'variant' AS axis, variant_index AS ix, {MISS} AS missing FROM k UNION ALL SELECT 'sample' AS axis, ix, missing FROM (" + _SM.format("ix") + ")")
add("a5_missing_dosage_variant", lambda s, d: S.ds_missing(load(s, d)), CUBE + "SELECT v.variant_index, CAST(SUM((c.variant_index IS NOT NULL AND c.ds IS NULL)::INT) AS DOUBLE) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM samples) AS missing FROM variants v LEFT JOIN calls c ON c.variant_index = v.variant_index GROUP BY v.variant_index")
add("a5_missing_dosage_sample", lambda s, d: S.ds_missing(load(s, d), per_variant=False), CUBE + "SELECT s.sample_index, CAST(SUM((c.variant_index IS NOT NULL AND c.ds IS NULL)::INT) AS DOUBLE) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM variants) AS missing FROM samples s LEFT JOIN calls c ON c.sample_index = s.sample_index GROUP BY s.sample_index")
add("a6_allele_freq_minor", lambda s, d: S.allele_freq(load(s, d), minor=True), CUBE + COUNTS + f"SELECT variant_index, {fold(AF0)} AS af FROM k")
add("a7_allele_freq_index1", lambda s, d: S.allele_freq(load(s, d), 1), CUBE + COUNTS + f"SELECT variant_index, CASE WHEN num_allele > 1 THEN {AF1} END AS af FROM k")
add("a7_allele_freq_index_vector", lambda s, d: S.allele_freq(load(s, d), (F.col("variant_index") % 2).cast("int")), CUBE + COUNTS + f"SELECT variant_index, CASE WHEN variant_index % 2 = 0 THEN {AF0} WHEN num_allele > 1 THEN {AF1} END AS af FROM k")
_AC = """, a AS (SELECT k.*, list_position(string_split(allele, ','), aa) - 1 AS ix FROM k), ca AS (SELECT a.variant_index, SUM((c.a1 = a.ix)::INT) AS x1, SUM((c.a2 = a.ix)::INT) AS x2, COUNT(c.variant_index) AS rec FROM a LEFT JOIN calls c ON c.variant_index = a.variant_index GROUP BY a.variant_index),
 b AS (SELECT a.*, CASE WHEN aa IS NOT NULL AND ix >= 0 THEN CAST(COALESCE(x1, 0) + COALESCE(x2, 0) + CASE WHEN ix = 0 THEN tot - 2 * rec ELSE 0 END AS BIGINT) END AS na FROM a JOIN ca ON ca.variant_index = a.variant_index)
"""
add("a8_allele_freq_ancestral", lambda s, d: S.allele_freq_of(load(s, d), F.col("aa")), CUBE + COUNTS + _AC + "SELECT variant_index, CAST(na AS DOUBLE) / NULLIF(CAST(tot - nm AS DOUBLE), 0e0) AS af FROM b")
_ALL = """, u AS (SELECT variant_index, num_allele, unnest(range(num_allele)) AS code FROM variants), e AS (SELECT variant_index, unnest([a1, a2]) AS code FROM calls),
 ec AS (SELECT variant_index, code, COUNT(*) AS c FROM e GROUP BY variant_index, code),
 uc AS (SELECT u.variant_index, u.code, k.tot, k.nm, CAST(COALESCE(ec.c, 0) + CASE WHEN u.code = 0 THEN k.tot - 2 * COALESCE(cc.rec, 0) ELSE 0 END AS BIGINT) AS c
   FROM u JOIN k ON k.variant_index = u.variant_index LEFT JOIN cc ON cc.variant_index = u.variant_index LEFT JOIN ec ON ec.variant_index = u.variant_index AND ec.code = u.code)
"""
add("a9_allele_freq_all", lambda s, d: S.all_allele_freqs(load(s, d)).select("variant_index", F.posexplode("af").alias("code", "af")), CUBE + COUNTS + _ALL + "SELECT variant_index, CAST(code AS INT) AS code, CAST(c AS DOUBLE) / NULLIF(CAST(tot - nm AS DOUBLE), 0e0) AS af FROM uc")
_DS = ", q AS (SELECT v.variant_index, CAST((SELECT COUNT(*) FROM samples) - SUM((c.variant_index IS NOT NULL AND c.ds IS NULL)::INT) AS BIGINT) AS num, COALESCE(SUM(c.ds), 0e0) AS s FROM variants v LEFT JOIN calls c ON c.variant_index = v.variant_index GROUP BY v.variant_index) "
add("a10_dosage_freq_ref", lambda s, d: S.ds_allele_freq(load(s, d)), CUBE + _DS + "SELECT variant_index, 1 - s / NULLIF(num * 2e0, 0e0) AS af FROM q")
add("a10_dosage_freq_alt", lambda s, d: S.ds_allele_freq(load(s, d), 1), CUBE + _DS + "SELECT variant_index, s / NULLIF(num * 2e0, 0e0) AS af FROM q")
add("a11_allele_count_minor", lambda s, d: S.allele_count(load(s, d), minor=True), CUBE + COUNTS + "SELECT variant_index, CASE WHEN tot > nm THEN least(n0, tot - nm - n0) END AS ac FROM k")
add("a11_allele_count_index1", lambda s, d: S.allele_count(load(s, d), 1), CUBE + COUNTS + "SELECT variant_index, CASE WHEN tot > nm AND num_allele > 1 THEN n1 END AS ac FROM k")
add("a11_allele_count_ancestral", lambda s, d: S.allele_count_of(load(s, d), F.col("aa")), CUBE + COUNTS + _AC + "SELECT variant_index, CASE WHEN tot > nm THEN na END AS ac FROM b")
add("a11_allele_count_all", lambda s, d: S.all_allele_counts(load(s, d)).select("variant_index", F.posexplode("counts").alias("code", "ac")), CUBE + COUNTS + _ALL + "SELECT variant_index, CAST(code AS INT) AS code, c AS ac FROM uc")
add("a12_dosage_count_ref", lambda s, d: S.ds_allele_count(load(s, d)), CUBE + _DS + "SELECT variant_index, CASE WHEN num > 0 THEN num * 2e0 - s END AS ac FROM q")
add("a12_dosage_count_alt", lambda s, d: S.ds_allele_count(load(s, d), 1), CUBE + _DS + "SELECT variant_index, CASE WHEN num > 0 THEN s END AS ac FROM q")
add("af_ac_missing", lambda s, d: S.af_ac_missing(load(s, d)), CUBE + COUNTS + f"SELECT variant_index, {AF0} AS af, CASE WHEN tot > nm THEN n0 END AS ac, {MISS} AS miss FROM k")
add("a13_af_ac_missing_dense", lambda s, d: S.af_ac_missing(load(s, d).dense(), dense=True), CUBE + COUNTS + f"SELECT variant_index, {AF0} AS af, CASE WHEN tot > nm THEN n0 END AS ac, {MISS} AS miss FROM k")
add("a13_af_ac_missing_coded", lambda s, d: S.af_ac_missing(load(s, d).coded(), coded=True), ORACLE_SQL["af_ac_missing"])
add("a7_allele_freq_index1_coded", lambda s, d: S.coded_counts(load(s, d).coded(), S.reference_index(1)).select("variant_index", S.frequency().alias("af")), ORACLE_SQL["a7_allele_freq_index1"])
_AFA = "CAST(tot - nm - n0 AS DOUBLE) / NULLIF(CAST(tot - nm AS DOUBLE), 0e0)"
add("a13_af_ac_missing_alt_minor_ns", lambda s, d: S.af_ac_missing(load(s, d), minor=True, alt=True, ns=True), CUBE + COUNTS + f", ns0 AS (SELECT CAST(COUNT(*) AS DOUBLE) AS m FROM samples) SELECT variant_index, {fold(_AFA)} AS af, CASE WHEN tot > nm THEN least(n0, tot - nm - n0) END AS ac, {MISS} AS miss, CAST(round_even(m * (1 - {MISS}), 0) AS BIGINT) AS ns FROM k CROSS JOIN ns0")
