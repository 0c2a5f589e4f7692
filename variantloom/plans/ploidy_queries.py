"""Queries on other ploidies, lists of dosages, merged arrays and VCF fields that share a name, with their SQL.

The cube's alleles are dealt anew: four to a sample (ploidy 4) or one (ploidy 1), so the same counts come out of other shapes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..operators import accessors as B
from ..operators import filters as L
from ..operators import matrix as G
from ..operators import merge as M
from ..operators import stats as S
from ..operators.get import get
from ..sources import vcf
from ..sources.fixture import CUBE, call_tasks, load
from .base import add
from .stats_queries import _DENSE
from .table_queries import _parts, _path


def dealt(s, d, ploidy: int) -> VariantDataset:
    """The cube with ``ploidy`` of its alleles to a sample, as recorded calls; alleles that fill no sample are left out."""
    ds = load(s, d)
    n = 2 * ds.n_samples // ploidy
    a = ds.calls.select("variant_index", F.explode(F.array(*[F.struct((2 * (F.col("sample_index") - 1) + k).alias("at"), F.col(f"a{k + 1}").alias("a")) for k in (0, 1)])).alias("x"))
    a = a.select("variant_index", (F.floor(F.col("x.at") / ploidy) + 1).cast("int").alias("sample_index"), (F.col("x.at") % ploidy).alias("k"), "x.a")
    if ploidy == 1:
        c = a.withColumn("g", F.array("a"))
    else:
        # An allele without a record is 0.
        own = lambda k: F.max(F.when(F.col("k") == k, F.struct("a")))
        a = a.repartition(call_tasks(s, d), "variant_index")
        c = a.groupBy("variant_index", "sample_index").agg(*[own(k).alias(f"_{k}") for k in range(ploidy)])
        c = c.withColumn("g", F.array(*[F.when(F.col(f"_{k}").isNotNull(), F.col(f"_{k}.a")).otherwise(0) for k in range(ploidy)]))
    c = c.where(F.col("sample_index") <= n).select("variant_index", "sample_index", "g", F.lit(False).alias("phase"), F.lit(None).cast("int").alias("dp"), F.lit(None).cast("double").alias("ds"))
    one = s.range(1, n + 1).select(F.col("id").cast("int").alias("sample_index"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("sample_id"))
    return VariantDataset(ds.variants, one, c, dict(ds.meta), ploidy)


def _cells(ploidy: int) -> str:
    return CUBE + _DENSE + f""", al AS (SELECT variant_index, 2 * (sample_index - 1) + k - 1 AS pos, CASE k WHEN 1 THEN a1 ELSE a2 END AS a FROM g, (SELECT unnest([1, 2]) AS k)),
 cell AS (SELECT variant_index, CAST(pos // {ploidy} + 1 AS INT) AS sample_index, COUNT(*) FILTER (a IS NULL) AS miss, COUNT(*) FILTER (a = 0) AS nref, COUNT(*) FILTER (a <> 0) AS nalt,
   string_agg(COALESCE(CAST(a AS VARCHAR), '.'), '/' ORDER BY pos) AS txt FROM al GROUP BY 1, 2 HAVING COUNT(*) = {ploidy}),
 dim AS (SELECT COUNT(DISTINCT sample_index) AS ns, COUNT(DISTINCT variant_index) AS nv FROM cell)
"""


def _text(c):
    return F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")


for _p, _name in ((4, "tetraploid"), (1, "haploid")):
    _sql = _cells(_p)
    add(f"a3_missing_sample_{_name}", lambda s, d, p=_p: S.missing_per_sample(dealt(s, d, p)), _sql + f"SELECT sample_index, CAST(SUM(miss) AS DOUBLE) / (SELECT CAST({_p} * nv AS DOUBLE) FROM dim) AS missing FROM cell GROUP BY sample_index")
    add(f"a4_missing_both_{_name}", lambda s, d, p=_p: S.missing_both(dealt(s, d, p)), _sql + f"SELECT 'sample' AS axis, sample_index AS ix, CAST(SUM(miss) AS DOUBLE) / (SELECT CAST({_p} * nv AS DOUBLE) FROM dim) AS missing FROM cell GROUP BY sample_index UNION ALL SELECT 'variant', variant_index, CAST(SUM(miss) AS DOUBLE) / (SELECT CAST({_p} * ns AS DOUBLE) FROM dim) FROM cell GROUP BY variant_index")
    add(f"a9_allele_freq_all_{_name}", lambda s, d, p=_p: S.all_allele_freqs(dealt(s, d, p)).select("variant_index", F.posexplode("af").alias("code", "af")),
        _sql + f", use AS (SELECT al.* FROM al, dim WHERE pos < ns * {_p}), t AS (SELECT variant_index, COUNT(a) AS n FROM use GROUP BY 1), k AS (SELECT variant_index, CAST(unnest(range(num_allele)) AS INT) AS code FROM variants) SELECT k.variant_index, code, CAST(COUNT(use.a) AS DOUBLE) / NULLIF(CAST(MAX(n) AS DOUBLE), 0e0) AS af FROM k JOIN t ON t.variant_index = k.variant_index LEFT JOIN use ON use.variant_index = k.variant_index AND use.a = code GROUP BY 1, 2")
    add(f"d5_dosage_sparse_{_name}", lambda s, d, p=_p: get(dealt(s, d, p), "$dosage_sp"), _sql + "SELECT sample_index, variant_index, CASE WHEN miss = 0 THEN CAST(nalt AS INT) END AS value FROM cell WHERE miss > 0 OR nalt > 0")
    add(f"d6_dosage_sparse2_{_name}", lambda s, d, p=_p: get(dealt(s, d, p), "$dosage_sp2"), _sql + f"SELECT sample_index, variant_index, CASE WHEN miss < {_p} THEN CAST(nalt AS INT) END AS value FROM cell WHERE miss = {_p} OR nalt > 0")
    add(f"b6_genotype_text_{_name}", lambda s, d, p=_p: B.geno(dealt(s, d, p), ["GT"]), _sql + f"SELECT variant_index, sample_index, CASE WHEN miss = {_p} THEN '.' ELSE txt END AS gt FROM cell")
    add(f"r5_genotype_table_{_name}", lambda s, d, p=_p: B.genotype_table(dealt(s, d, p)), _sql + "SELECT CASE WHEN miss = 0 THEN txt END AS gt, COUNT(*) AS n FROM cell GROUP BY 1")
    add(f"g2_pack_by_sample_{_name}", lambda s, d, p=_p: G.pack_by_sample(dealt(s, d, p)), _sql + f"SELECT sample_index, CAST((variant_index - 1) // 4 AS BIGINT) AS block, CAST(SUM((CASE WHEN miss = {_p} THEN 3 ELSE least(nalt, 3) END) << CAST(2 * ((variant_index - 1) % 4) AS INT)) + CASE COUNT(*) WHEN 1 THEN 252 WHEN 2 THEN 240 WHEN 3 THEN 192 ELSE 0 END AS INT) AS packed FROM cell GROUP BY 1, 2")
    add(f"r4_inbreeding_{_name}", lambda s, d, p=_p: G.inbreeding(dealt(s, d, p)),
        _sql + f", f AS (SELECT variant_index, CAST(SUM(nref) AS DOUBLE) / NULLIF(CAST(SUM({_p} - miss) AS DOUBLE), 0e0) AS p FROM cell GROUP BY 1), h AS (SELECT sample_index, p, CASE WHEN miss = 0 THEN CAST(nref AS DOUBLE) END AS g FROM cell JOIN f ON f.variant_index = cell.variant_index WHERE p > 0 AND p < 1) SELECT sample_index, AVG((g * g - g * (1 + 2 * p) + 2 * p * p) / (2 * p * (1 - p))) AS f FROM h GROUP BY 1")


def _merged(s, d, ploidy: int, by_samples: bool) -> VariantDataset:
    ds = dealt(s, d, ploidy).dense().with_(calls=None)
    ds = ds.with_(variants=ds.variants.drop("dp", "ds"))
    # A FORMAT field of one value a sample, of every second variant.
    n = ds.n_samples
    depth = F.when(F.col("variant_index") % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array(F.col("variant_index") + i)))
    ds = ds.with_(variants=ds.variants.withColumn("fmt_DP", depth))
    if by_samples:
        odd, even = (ds.filtered(samples=ds.samples.where(f"sample_index % 2 = {k}")) for k in (1, 0))
        gone = F.col("chromosome") != "3"
        return M.merge_samples(odd, L.by_flag(even, gone))
    low = F.col("chromosome").isin("1", "2", "3")
    some = ds.filtered(samples=ds.samples.where("sample_index % 3 <> 0"))
    return M.merge_variants(L.by_flag(some, low), L.by_flag(ds, ~low))


def _cell_texts(m: VariantDataset):
    c = B.geno(m, ["GT", "DP"]).join(m.variants.select("variant_index", "chromosome", "position", "p_partkey"), "variant_index").join(m.samples.select("sample_index", "sample_id"), "sample_index")
    return c.select("p_partkey", "sample_id", "gt", F.get("dp", F.lit(0)).alias("dp"))


for _p, _name in ((2, "diploid"), (4, "tetraploid")):
    _row = f"SELECT v.p_partkey, 't' || c.sample_index AS sample_id, CASE WHEN {{gone}} OR miss = {_p} THEN '.' ELSE txt END AS gt, CASE WHEN v.variant_index % 2 = 0 AND NOT ({{gone}}) THEN CAST(v.variant_index + c.sample_index AS INT) END AS dp FROM cell c JOIN variants v ON v.variant_index = c.variant_index"
    add(f"m2_merge_variants_arrays_{_name}", lambda s, d, p=_p: _cell_texts(_merged(s, d, p, False)), _cells(_p) + _row.format(gone="(v.chromosome IN ('1', '2', '3') AND c.sample_index % 3 = 0)"))
    add(f"m3_merge_samples_arrays_{_name}", lambda s, d, p=_p: _cell_texts(_merged(s, d, p, True)), _cells(_p) + _row.format(gone="(v.chromosome = '3' AND c.sample_index % 2 = 0)"))


# Dosages with a column for each alternative allele: the k-th is the cube's dosage over k.
def _lists(s, d) -> VariantDataset:
    ds = load(s, d)
    m = ds.variants.select("variant_index", F.greatest(F.col("num_allele") - 1, F.lit(1)).alias("_m"))
    return ds.with_(calls=ds.calls.join(m, "variant_index").withColumn("ds", F.transform(F.sequence(F.lit(1), F.col("_m")), lambda k: F.col("ds") / k)).drop("_m"))


_L = CUBE + _DENSE + """, x AS (SELECT g.variant_index, sample_index, num_allele, greatest(num_allele - 1, 1) AS m, k, CASE WHEN k <= greatest(num_allele - 1, 1) THEN ds / k END AS v
   FROM g JOIN variants USING (variant_index), (SELECT unnest([1, 2, 3]) AS k) WHERE k <= greatest(num_allele - 1, 1)),
 q AS (SELECT variant_index, MAX(num_allele) AS na, MAX(m) AS m, COUNT(v) AS num, COUNT(*) AS cells, COALESCE(SUM(v), 0e0) AS s, COUNT(v) FILTER (k = 2) AS num2, COALESCE(SUM(v) FILTER (k = 2), 0e0) AS s2 FROM x GROUP BY 1)
"""
_AF = "1 - s * m / NULLIF(num * 2e0, 0e0)"
add("a5_missing_dosage_lists", lambda s, d: S.ds_missing(_lists(s, d)), _L + "SELECT variant_index, CAST(cells - num AS DOUBLE) / cells AS missing FROM q")
add("a5_missing_dosage_lists_sample", lambda s, d: S.ds_missing(_lists(s, d), per_variant=False), _L + "SELECT sample_index, CAST(COUNT(DISTINCT variant_index) FILTER (v IS NULL) AS DOUBLE) / (SELECT COUNT(*) FROM variants) AS missing FROM x GROUP BY 1")
add("a10_dosage_freq_lists", lambda s, d: S.ds_allele_freq(_lists(s, d)), _L + f"SELECT variant_index, {_AF} AS af FROM q")
add("a10_dosage_freq_lists_second", lambda s, d: S.ds_allele_freq(_lists(s, d), 2), _L + "SELECT variant_index, CASE WHEN na > 2 THEN s2 / NULLIF(num2 * 2e0, 0e0) END AS af FROM q")
add("a12_dosage_count_lists", lambda s, d: S.ds_allele_count(_lists(s, d)), _L + "SELECT variant_index, CASE WHEN num > 0 THEN num * 2e0 / m - s END AS ac FROM q")
add("a12_dosage_count_lists_second", lambda s, d: S.ds_allele_count(_lists(s, d), 2), _L + "SELECT variant_index, CASE WHEN num2 > 0 AND na > 2 THEN s2 END AS ac FROM q")
add("a13_dosage_lists", lambda s, d: S.ds_af_ac_missing(_lists(s, d), minor=True, ns=True), _L + f"SELECT variant_index, CASE WHEN {_AF} > 0.5e0 THEN 1 - ({_AF}) ELSE {_AF} END AS af, CASE WHEN num > 0 THEN least(num * 2e0 / m - s, s) END AS ac, CAST(cells - num AS DOUBLE) / cells AS miss, CAST(round_even((SELECT COUNT(*) FROM samples) * (1 - CAST(cells - num AS DOUBLE) / cells), 0) AS BIGINT) AS ns FROM q")
add("a13_dosage_column", lambda s, d: S.ds_af_ac_missing(load(s, d), alt=True), CUBE + ", q AS (SELECT v.variant_index, CAST((SELECT COUNT(*) FROM samples) - SUM((c.variant_index IS NOT NULL AND c.ds IS NULL)::INT) AS BIGINT) AS num, COALESCE(SUM(c.ds), 0e0) AS s, (SELECT COUNT(*) FROM samples) AS n FROM variants v LEFT JOIN calls c ON c.variant_index = v.variant_index GROUP BY v.variant_index) SELECT variant_index, s / NULLIF(num * 2e0, 0e0) AS af, CASE WHEN num > 0 THEN s END AS ac, CAST(n - num AS DOUBLE) / n AS miss FROM q")


# A VCF file of the whole cube whose INFO fields are called ID, Position and AA, like columns or each other but for case.
def _names(s, d):
    ds = load(s, d)
    v = ds.variants.withColumns({"info_ID": F.concat(F.lit("i"), F.col("variant_id").cast("string")), "info_Position": F.col("position") + 1, "AA_": F.coalesce(F.col("aa"), F.lit("N"))})
    ds = ds.with_(variants=v, meta=ds.meta | {"vcf": {"columns": {"info_ID": "ID", "info_Position": "Position", "AA_": "aa"}}})
    path = _path(s, "vcf")
    vcf.write_vcf(ds, path, info=["info_ID", "info_Position", "ac", "AA_"], fmt=["dp"])
    got = vcf.read_vcf(s, *_parts(s, path))
    depth = F.aggregate(F.flatten(F.coalesce("fmt_DP", F.array().cast("array<array<int>>"))), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return got.variants.select("variant_index", "chromosome", "position", "id", "num_allele", "info_ID", "info_Position", "ac", "aa", depth.alias("depth"))


add("s6_vcf_field_names", _names, CUBE + """, t AS (SELECT variant_index, SUM(dp) AS depth FROM calls GROUP BY 1)
 SELECT v.variant_index, chromosome, position, id, num_allele, 'i' || variant_id AS "info_ID", CAST(position + 1 AS INT) AS "info_Position", ac, COALESCE(aa, 'N') AS aa, CAST(COALESCE(depth, 0) AS INT) AS depth FROM variants v LEFT JOIN t ON t.variant_index = v.variant_index""")


def _blocks(s, d):
    path = _path(s, "bgzf")
    vcf.write_vcf(load(s, d), path, info=["ac"], fmt=[], compression="bgzf")
    files = s.read.format("binaryFile").load(path).select("path", "content")
    lines = files.mapInPandas(_unpacked, "value string")
    return lines.where(~F.col("value").startswith("#")).select(F.substring_index("value", "\t", 5).alias("head"), F.regexp_extract("value", "\tac=([0-9]+)\t", 1).cast("int").alias("ac"))


def _unpacked(frames):
    import gzip

    import pandas as pd

    for f in frames:
        yield pd.DataFrame({"value": pd.Series([x for b in f["content"] for x in gzip.decompress(b).decode().split("\n") if x], dtype=object)})


add("k5_bgzf", _blocks, CUBE + "SELECT concat_ws(chr(9), chromosome, position, CASE WHEN id = '' THEN '.' ELSE id END, split_part(allele, ',', 1), CASE WHEN strpos(allele, ',') > 0 THEN substr(allele, strpos(allele, ',') + 1) ELSE '.' END) AS head, ac FROM variants")
