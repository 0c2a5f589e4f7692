"""Queries on file parsing, text, merging decisions and further changes (E, J6, K, M1, M6, M8, O, S, U, X), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vcf_text as T
from ..operators import apply as U
from ..operators import filters as L
from ..operators import merge as M
from ..operators import mutate as X
from ..operators import stats as S
from ..operators import units as W
from ..operators.get import get
from ..session import block_size
from ..sources import store, vcf
from ..sources.fixture import CUBE, load
from .base import add
from .stats_queries import _ALT, _DENSE, AF0, AF1, COUNTS
from .table_queries import _path, _sides

_TAB = "\t"
MINI = [
    "##fileformat=VCFv4.2",
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">',
    '##INFO=<ID=HM,Number=0,Type=Flag,Description="In map">',
    '##INFO=<ID=AC,Number=A,Type=Integer,Description="Count">',
    '##INFO=<ID=AD,Number=R,Type=Integer,Description="Depths">',
    '##INFO=<ID=GP,Number=G,Type=Float,Description="Probabilities">',
    '##INFO=<ID=XX,Number=.,Type=String,Description="Any">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=DP,Number=.,Type=Integer,Description="Depth">',
    '##FILTER=<ID=q10,Description="Low">',
    _TAB.join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "s1", "s2"]),
    _TAB.join(["chr1", "100", "rs1", "A", "C", "30.5", "PASS", "DP=7;HM;AC=3;AD=1,2;GP=0.1,0.2,0.7;ZZ=9;DP=8", "GT:DP", "0|1:3", "./.:."]),
    _TAB.join(["1", "200", ".", "G", "T,C", ".", ".", "AC=1;XX=a,.,b", "GT", "1/2", "0"]),
    _TAB.join(["Chr2", "300", "x", ".", ".", "1e3", "q10", ".", "GT", "0/0/1", ".|1"]),
    _TAB.join(["X", "400", "", "C", "<DEL>", "5", "PASS", "DP=.;AC=.", "DP:GT", "4,5:1|1", "6:0/1"]),
]


def _mini(s) -> str:
    path = _path(s, "mini")
    s.createDataFrame([(x,) for x in MINI], "value string").coalesce(1).write.text(path)
    return s.read.text(path).inputFiles()[0]


def _text(a):
    return F.array_join(F.transform(a, lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",")


def _rows(*rows: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") t"


def _read(s, **k):
    return vcf.read_vcf(s, _mini(s), **k).variants


# Files.
add("s1_open_store", lambda s, d: _opened(s, d), CUBE + "SELECT sample_index, sample_id FROM samples")


def _opened(s, d):
    path = _path(s, "store")
    ds = load(s, d)
    store.save(ds.with_(calls=None), path)
    return store.open_store(s, path).samples.select("sample_index", "sample_id")


add("s3_header", lambda s, d: s.createDataFrame([(k, e["ID"], e.get("Number", ""), e.get("Type", ""), e["Description"]) for h in [vcf.read_header(s, _mini(s))] for k in ("info", "format", "filter") for e in getattr(h, k).values()], "kind string, id string, number string, type string, description string"),
    _rows("('info', 'DP', '1', 'Integer', 'Depth, total')", "('info', 'HM', '0', 'Flag', 'In map')", "('info', 'AC', 'A', 'Integer', 'Count')", "('info', 'AD', 'R', 'Integer', 'Depths')", "('info', 'GP', 'G', 'Float', 'Probabilities')", "('info', 'XX', '.', 'String', 'Any')", "('format', 'GT', '1', 'String', 'Genotype')", "('format', 'DP', '.', 'Integer', 'Depth')", "('filter', 'q10', '', '', 'Low')") + "(kind, id, number, type, description)")
add("s4_sample_ids", lambda s, d: s.createDataFrame(list(enumerate(vcf.sample_ids(s, _mini(s)), 1)), "sample_index int, sample_id string"), _rows("(1, 's1')", "(2, 's2')") + "(sample_index, sample_id)")
add("s5_row_count", lambda s, d: s.range(1).select(F.lit(vcf.count_rows(s, _mini(s))).cast("long").alias("n")), "SELECT CAST(4 AS BIGINT) AS n")
add("s6_vcf_columns", lambda s, d: _read(s).select("variant_index", "chromosome", "position", "allele", "id", "qual", "filter"), _rows("(1, '1', 100, 'A,C', 'rs1', 30.5e0, 'PASS')", "(2, '1', 200, 'G,T,C', '', NULL, NULL)", "(3, '2', 300, '.', 'x', 1000e0, 'q10')", "(4, 'X', 400, 'C,<DEL>', '', 5e0, 'PASS')") + "(variant_index, chromosome, position, allele, id, qual, filter)")
add("s6_vcf_slice", lambda s, d: _read(s, start=2, count=2).select("variant_index", "position"), _rows("(1, 200)", "(2, 300)") + "(variant_index, position)")
add("s6_vcf_two_files", lambda s, d: (lambda p: vcf.read_vcf(s, p, p).variants.select("variant_index", "position"))(_mini(s)), _rows(*[f"({i + 1}, {(i % 4 + 1) * 100})" for i in range(8)]) + "(variant_index, position)")
add("s7_vcf_info", lambda s, d: _read(s).select("variant_index", "DP", "HM", _text(F.col("AC")).alias("AC"), _text(F.col("AD")).alias("AD"), _text(F.col("XX")).alias("XX"), F.size("GP").alias("GP")), _rows("(1, 7, TRUE, '3', '1,2', '', 3)", "(2, NULL, FALSE, '1,.', '', 'a,,b', 0)", "(3, NULL, FALSE, '', '', '', 0)", "(4, NULL, FALSE, '.', '', '', 0)") + '(variant_index, "DP", "HM", "AC", "AD", "XX", "GP")')
add("s7_vcf_genotypes", lambda s, d: _read(s).select("variant_index", _text(F.col("gt")).alias("gt"), _text(F.transform("phase", lambda x: x.cast("int"))).alias("phase"), F.size("geno_extra").alias("extra")), _rows("(1, '0,1,.,.', '1,0', 0)", "(2, '1,2,0,.', '0,0', 0)", "(3, '0,0,.,1', '0,1', 1)", "(4, '1,1,0,1', '1,0', 0)") + "(variant_index, gt, phase, extra)")
add("s7_vcf_format", lambda s, d: _read(s).select("variant_index", F.array_join(F.transform("fmt_DP", _text), "|").alias("dp")), _rows("(1, '3|.')", "(2, NULL)", "(3, NULL)", "(4, '4,5|6')") + "(variant_index, dp)")
_HEAD = f"concat_ws(chr(9), chromosome, position, CASE WHEN id = '' THEN '.' ELSE id END, split_part(allele, ',', 1), CASE WHEN {_ALT} = '' THEN '.' ELSE {_ALT} END, COALESCE(filter, '.'))"
add("k2_head_columns", lambda s, d: load(s, d).variants.select("variant_index", F.concat_ws("\t", *[c for i, c in enumerate(T.head_columns()) if i != 5]).alias("head")), CUBE + f"SELECT variant_index, {_HEAD} AS head FROM variants")
add("k3_info_text", lambda s, d: load(s, d, info=True).variants.select("variant_index", F.array_join(F.array_compact(F.array(T.info_entry("BN", F.col("bn"), "array<int>"), T.info_entry("AA", F.col("aa"), "string"), T.info_entry("EVEN", F.col("ac") % 2 == 0, "boolean"))), ";").alias("info")),
    CUBE + ", b AS (SELECT variant_index, string_agg(v, ',' ORDER BY k) AS bn FROM info_bn GROUP BY variant_index) SELECT v.variant_index, concat_ws(';', 'BN=' || bn, 'AA=' || aa, CASE WHEN ac % 2 = 0 THEN 'EVEN' END) AS info FROM variants v LEFT JOIN b ON b.variant_index = v.variant_index")
add("k4_genotype_text", lambda s, d: load(s, d).dense().variants.select("variant_index", F.array_join(C.gt_text(F.col("gt"), F.col("phase")), " ").alias("gt")), CUBE + _DENSE + "SELECT variant_index, string_agg(COALESCE(CAST(a1 AS VARCHAR), '.') || CASE WHEN phase THEN '|' ELSE '/' END || COALESCE(CAST(a2 AS VARCHAR), '.'), ' ' ORDER BY sample_index) AS gt FROM g GROUP BY variant_index")
add("k10_to_text", lambda s, d: _written(s, d), CUBE + "SELECT variant_index || ':' || allele AS value FROM variants")


def _written(s, d):
    path = _path(s, "lines")
    U.write_lines(load(s, d).variants.select("variant_index", F.concat_ws(":", "variant_index", "allele").alias("value")), path)
    return s.read.text(path)


add("k10_to_raw", lambda s, d: _raw(s, d), CUBE + "SELECT variant_index, lower(concat(substr(h, 7, 2), substr(h, 5, 2), substr(h, 3, 2), substr(h, 1, 2))) AS raw FROM (SELECT variant_index, lpad(hex(position), 8, '0') AS h FROM variants)")


def _raw(s, d):
    path = _path(s, "raw")
    U.write_raw(load(s, d).variants.select("variant_index", F.col("position").alias("value")), path)
    return s.read.parquet(path).select("variant_index", F.lower(F.hex("raw")).alias("raw"))


add("k11_recompress", lambda s, d: _recompressed(s, d), CUBE + "SELECT variant_index, chromosome, position FROM variants")


def _recompressed(s, d):
    a, b = _path(s, "store"), _path(s, "store")
    store.save(load(s, d).with_(calls=None), a, "fast")
    store.recompress(s, a, b, "zip")
    return store.open_store(s, b).variants.select("variant_index", "chromosome", "position")


add("k12_presets", lambda s, d: s.createDataFrame(sorted(store.PRESETS.items()), "preset string, codec string"), _rows("('none', 'uncompressed')", "('fast', 'snappy')", "('lz4', 'lz4')", "('default', 'zstd')", "('zip', 'gzip')", "('max', 'zstd')", "('ultra', 'zstd')") + "(preset, codec)")

# Scalar functions over inline text.


def _inline(s, rows: list[str]):
    return s.createDataFrame(list(enumerate(rows)), "i int, x string")


add("e1_integer_list", lambda s, d: _inline(s, ["1,2", ".", " 7 ,.", "x,3", "99999999999"]).select("i", _text(T.values(F.col("x"), "Integer")).alias("v")), _rows("(0, '1,2')", "(1, '.')", "(2, '7,.')", "(3, '.,3')", "(4, '.')") + "(i, v)")
add("e2_float_list", lambda s, d: _inline(s, ["1.5,.", "1e-3", "-2", "abc"]).select("i", F.get(T.values(F.col("x"), "Float"), F.lit(0)).alias("v")), _rows("(0, 1.5e0)", "(1, 0.001e0)", "(2, -2e0)", "(3, NULL)") + "(i, v)")
add("e3_string_list", lambda s, d: _inline(s, ["a, b", ".", "x,.,y"]).select("i", F.array_join(T.values(F.col("x"), "String"), "|").alias("v")), _rows("(0, 'a|b')", "(1, '')", "(2, 'x||y')") + "(i, v)")
add("e4_e8_genotypes", lambda s, d: _inline(s, ["0|1", "./.", "2", "0/1/2", ".|1"]).select("i", _text(T.alleles_of(F.col("x"))).alias("codes"), _text(T.padded(T.alleles_of(F.col("x")), 2)).alias("diploid")), _rows("(0, '0,1', '0,1')", "(1, '.,.', '.,.')", "(2, '2', '2,.')", "(3, '0,1,2', '0,1')", "(4, '.,1', '.,1')") + "(i, codes, diploid)")
add("e5_number_check", lambda s, d: s.createDataFrame([(n, k) for n in ("A", "R", "G", "2") for k in (1, 2, 3)], "number string, n_allele int").select("number", "n_allele", F.coalesce(*[F.when(F.col("number") == n, F.size(T.sized(F.array(F.lit(1)), n, F.col("n_allele"), "X", "int", strict=False))) for n in ("A", "R", "G", "2")]).alias("size")),
    "SELECT number, n_allele, CAST(CASE number WHEN 'A' THEN n_allele - 1 WHEN 'R' THEN n_allele WHEN 'G' THEN n_allele * (n_allele + 1) / 2 ELSE 2 END AS INT) AS size FROM (SELECT unnest(['A', 'R', 'G', '2']) AS number), (SELECT CAST(unnest([1, 2, 3]) AS INT) AS n_allele)")
add("e6_missing_info", lambda s, d: _inline(s, ["A", "R", "."]).select("i", *[F.size(T.sized(F.lit(None).cast("array<int>"), n, F.lit(3), "X", "int")).alias(f"n_{k}") for k, n in (("a", "A"), ("dot", "."), ("two", "2"))]), _rows("(0, 0, 0, 2)", "(1, 0, 0, 2)", "(2, 0, 0, 2)") + "(i, n_a, n_dot, n_two)")
add("e7_info_keys", lambda s, d: _inline(s, ["DP=7;DP=8", "XDP=1;DP=2", "DP", "AC=1", "."]).select("i", T.info_text(F.col("x"), "DP").alias("v")), _rows("(0, '7')", "(1, '2')", "(2, '')", "(3, NULL)", "(4, NULL)") + "(i, v)")
add("e9_codes_to_alleles", lambda s, d: _inline(s, ["0/1", "2|0", "./."]).select("i", (F.array_max(T.alleles_of(F.col("x"))) + 1).alias("n")), _rows("(0, 2)", "(1, 3)", "(2, NULL)") + "(i, n)")
add("e10_chromosome_prefix", lambda s, d: _inline(s, ["chr1", "CHRX", "1", "contig_chr"]).select("i", T.strip_prefix(F.col("x")).alias("v")), _rows("(0, '1')", "(1, 'X')", "(2, '1')", "(3, 'contig_chr')") + "(i, v)")
add("e11_allele_index", lambda s, d: load(s, d).variants.select("variant_index", C.allele_index(F.col("allele"), F.col("aa")).alias("ix")), CUBE + "SELECT variant_index, CASE WHEN list_contains(string_split(allele, ','), aa) THEN CAST(list_position(string_split(allele, ','), aa) - 1 AS INT) END AS ix FROM variants")
add("e13_lists_and_lengths", lambda s, d: load(s, d, info=True).variants.select("variant_index", F.size("bn").alias("length"), F.aggregate("bn", F.lit(0), lambda a, x: a + x).alias("total")), CUBE + "SELECT v.variant_index, CAST(COUNT(b.k) AS INT) AS length, CAST(COALESCE(SUM(b.v), 0) AS INT) AS total FROM variants v LEFT JOIN info_bn b ON b.variant_index = v.variant_index GROUP BY v.variant_index")
add("e14_text_of_numbers", lambda s, d: load(s, d).variants.select("variant_index", T.text_of(F.col("position"), "int").alias("position"), T.text_of(F.col("id"), "string").alias("id")), CUBE + "SELECT variant_index, CAST(position AS VARCHAR) AS position, CASE WHEN id = '' THEN '.' ELSE id END AS id FROM variants")

# Merging.
add("m1_merge_decides", lambda s, d: _dims(s, M.merge(*_sides(s, d))), CUBE + "SELECT CAST(2 AS BIGINT) AS ploidy, (SELECT COUNT(*) FROM samples) AS samples, (SELECT COUNT(*) FROM variants) AS variants")


def _dims(s, ds):
    return s.createDataFrame([ds.dims()], "ploidy long, samples long, variants long")


add("m6_merge_meta", lambda s, d: s.createDataFrame(sorted((k, str(v)) for k, v in M.merge_meta(*[x.with_(meta={"a": i, "b": "same", "md5": i}) for i, x in enumerate(_sides(s, d))]).items()), "name string, value string"), _rows("('a', '[0, 1]')", "('b', 'same')") + "(name, value)")
add("m8_index_sets", lambda s, d: _sets(s), _rows("('intersect', '2,3')", "('except', '1')", "('union', '1,2,3,4')") + "(op, index)")


def _sets(s):
    u = W.create(s, [[1, 2, 3], [2, 3, 4]]).groupBy().agg(F.min_by("index", "unit_ix").alias("a"), F.max_by("index", "unit_ix").alias("b"))
    ops = {"intersect": F.array_intersect("a", "b"), "except": F.array_except("a", "b"), "union": F.array_union("a", "b")}
    return u.select(F.explode(F.array(*[F.struct(F.lit(k).alias("op"), _text(x).alias("index")) for k, x in ops.items()])).alias("x")).select("x.*")


add("j6_external_reference", lambda s, d: _by_vector(s, d), CUBE + COUNTS + f"SELECT variant_index, CASE WHEN position % 2500 = 1000 THEN {AF0} WHEN num_allele > 1 THEN {AF1} END AS af FROM k")


def _by_vector(s, d):
    ds = load(s, d)
    vector = ds.variants.select("variant_index", F.when(F.col("position") % 2500 == 1000, 0).otherwise(1).alias("ref_allele"))
    return S.allele_freq(ds.with_(variants=ds.variants.join(vector, "variant_index")), F.col("ref_allele"))


# Order and parts.
add("o2_sorted_queries", lambda s, d: L.numbered(load(s, d).variants.select("variant_index", "position"), "position").groupBy("position").agg(F.min("_rank").alias("first")), CUBE + ", r AS (SELECT position, ROW_NUMBER() OVER (ORDER BY position) AS n FROM variants) SELECT position, MIN(n) AS first FROM r GROUP BY position")
add("o3_sorted_windows", lambda s, d: W.sliding_windows(load(s, d).variants.orderBy(F.col("position").desc())).select("chromosome", "start"), CUBE + ", e AS (SELECT chromosome, variant_index, unnest(range(CAST(greatest(floor((position - 5000) / 2500e0) + 1, 0) AS BIGINT), CAST(floor(position / 2500e0) AS BIGINT) + 1)) AS k FROM variants), w AS (SELECT chromosome, k, list_sort(list(variant_index)) AS ix FROM e GROUP BY chromosome, k), u AS (SELECT *, lag(ix) OVER (PARTITION BY chromosome ORDER BY k) AS prev FROM w) SELECT chromosome, CAST(k * 2500 AS INT) AS start FROM u WHERE prev IS NULL OR prev <> ix")
add("c5_block_size", lambda s, d: s.createDataFrame([(n, w, block_size(n, w)) for n in (10, 1000) for w in (1, 4, 7)], "n long, workers long, size long"), "SELECT n, workers, CAST(ceil(n / (3e0 * workers)) AS BIGINT) AS size FROM (SELECT CAST(unnest([10, 1000]) AS BIGINT) AS n), (SELECT CAST(unnest([1, 4, 7]) AS BIGINT) AS workers)")

# User functions.
add("u1_apply_list", lambda s, d: U.apply_variants(load(s, d), "allele", lambda a: [len(x) for x in a.split(",")], "list:integer").select("variant_index", F.posexplode("value").alias("k", "length")), CUBE + "SELECT variant_index, CAST(k - 1 AS INT) AS k, CAST(length(a[k]) AS BIGINT) AS length FROM (SELECT variant_index, string_split(allele, ',') AS a, unnest(range(1, len(string_split(allele, ',')) + 1)) AS k FROM variants)")
add("u3_block_apply", lambda s, d: W.block_apply(load(s, d).variants.select("variant_index", "position"), _block_mean, "block long, mean double", 64), CUBE + "SELECT CAST(floor((variant_index - 1) / 64e0) + 1 AS BIGINT) AS block, AVG(CAST(position AS DOUBLE)) AS mean FROM variants GROUP BY 1")


def _block_mean(frame):
    import pandas as pd

    return pd.DataFrame({"block": [frame["block"].iloc[0]], "mean": [float(frame["position"].mean())]})


add("u4_unit_apply", lambda s, d: _unit_sizes(s, d), CUBE + "SELECT CAST(ROW_NUMBER() OVER (ORDER BY MIN(variant_index)) AS BIGINT) AS unit_ix, COUNT(*) AS n FROM variants GROUP BY chromosome")


def _unit_sizes(s, d):
    import pandas as pd

    v = load(s, d).variants.select("variant_index", "chromosome")
    u = v.groupBy("chromosome").agg(F.array_sort(F.collect_list("variant_index")).alias("index")).withColumn("start", F.lit(0))
    return W.unit_apply(W.number_units(u, v), v, lambda key, f: pd.DataFrame({"unit_ix": [key[0]], "n": [len(f)]}), "unit_ix long, n long")


add("u5_parallel", lambda s, d: _par(s, d), CUBE + "SELECT COUNT(*) AS n, CAST(SUM(position) AS BIGINT) AS total FROM variants")


def _par(s, d):
    import pandas as pd

    ds = load(s, d)
    parts = U.parallel(ds.with_(variants=ds.variants.select("variant_index", "position")), lambda f: pd.DataFrame({"n": [len(f)], "total": [int(f["position"].sum())]}), "n long, total long", parts=5)
    return parts.agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


add("u5_parallel_forms", lambda s, d: _forms(s, d), CUBE + "SELECT (SELECT COUNT(*) FROM variants) AS variants, (SELECT CAST(SUM(position) AS BIGINT) FROM variants) AS total, (SELECT MAX(position) FROM variants) AS top, (SELECT COUNT(*) FROM samples) AS samples, 15 AS numbers")


def _forms(s, d):
    ds = load(s, d)
    ds = ds.with_(variants=ds.variants.select("variant_index", "position"))
    got = (sum(U.parallel_apply(ds, len, combine_by="unlist")), U.parallel_apply(ds, lambda f: int(f["position"].sum()), combine_by="+"), U.parallel_apply(ds, lambda f: int(f["position"].max()), combine_by=max), sum(U.parallel_apply(ds, len, "by.sample", "list")), sum(U.parallel_apply(ds, lambda i: i, "none", parts=5)))
    return s.createDataFrame([got], "variants long, total long, top int, samples long, numbers int")


add("u7_absolute_index", lambda s, d: U.apply_variants(L.by_chromosome(load(s, d), ["4"]), "ac", lambda i, x: i, "integer", "absolute"), CUBE + "SELECT variant_index, CAST(variant_index AS BIGINT) AS value FROM variants WHERE chromosome = '4'")
add("u8_process_parts", lambda s, d: U.process_parts(load(s, d).variants.select("variant_index").repartition(4)).agg(F.sum("n").alias("n"), F.max("process_count").alias("process_count")), CUBE + "SELECT CAST(COUNT(*) AS BIGINT) AS n, 4 AS process_count FROM variants")
add("u10_dosage_blocks", lambda s, d: W.blocks(get(load(s, d), "$dosage"), 50).groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate(F.filter("value", lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x)).alias("total")), CUBE + _DENSE + "SELECT CAST(floor((variant_index - 1) / 50e0) + 1 AS BIGINT) AS block, COUNT(DISTINCT variant_index) AS n, CAST(SUM(CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN (a1 = 0)::INT + (a2 = 0)::INT END) AS BIGINT) AS total FROM g GROUP BY 1")

# Changes.
add("x2_variant_ids", lambda s, d: X.add_value(load(s, d), "variant.id", F.col("variant_id") + 1000, replace=True).variants.select("variant_index", "variant_id"), CUBE + "SELECT variant_index, variant_id + 1000 AS variant_id FROM variants")
add("x4_annotation", lambda s, d: X.add_value(X.add_value(X.add_value(load(s, d), "annotation/id", F.concat(F.lit("v"), F.col("variant_id").cast("string")), replace=True), "annotation/filter", F.lit("PASS"), replace=True), "annotation/qual", F.lit(1.5), replace=True).variants.select("variant_index", "id", "filter", "qual"), CUBE + "SELECT variant_index, 'v' || variant_id AS id, 'PASS' AS filter, CAST(1.5 AS DOUBLE) AS qual FROM variants")
add("x5_info_folder", lambda s, d: X.add_value(load(s, d), "annotation/info/f", {"a": F.col("ac") + 1, "b": F.col("aa")}).variants.select("variant_index", F.col("f.a").alias("a"), F.col("f.b").alias("b")), CUBE + "SELECT variant_index, CAST(ac + 1 AS INT) AS a, aa AS b FROM variants")
add("x5_info_table", lambda s, d: _info_table(s, d), CUBE + "SELECT variant_index, CASE WHEN variant_index % 2 = 0 THEN CAST(variant_index * 3 AS INT) END AS t FROM variants")


def _info_table(s, d):
    ds = load(s, d)
    return X.add_value(ds, "annotation/info/t", ds.variants.where("variant_index % 2 = 0").select("variant_index", (F.col("variant_index") * 3).alias("v"))).variants.select("variant_index", "t")


add("x12_fill", lambda s, d: X.append_fill(load(s, d).samples, "batch", 7).select("sample_index", "batch"), CUBE + "SELECT sample_index, 7 AS batch FROM samples")
add("w2_units_of_positions", lambda s, d: W.create(s, [[3, 1, None], [9]]).select("unit_ix", F.size("index").alias("n")), _rows("(CAST(1 AS BIGINT), 2)", "(2, 1)") + "(unit_ix, n)")

# Dosage input, exports and recipes.
add("s11_major_reference", lambda s, d: _turned(s, d), CUBE + _DENSE + ", t AS (SELECT variant_index, SUM(CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN (a1 = 0)::INT + (a2 = 0)::INT END) AS s, COUNT(*) FILTER (a1 IS NOT NULL AND a2 IS NOT NULL) AS n FROM g GROUP BY variant_index) SELECT v.variant_index, CASE WHEN COALESCE(s, 0) < n THEN 'B,A' ELSE 'A,B' END AS allele FROM variants v JOIN t ON t.variant_index = v.variant_index")


def _turned(s, d):
    from ..sources import plink

    ds = load(s, d)
    rows = plink.to_dosages(ds).withColumn("allele", F.lit("A/B"))
    return plink.from_dosages(rows, ds.samples).variants.select("variant_index", "allele")


add("s11_real_dosages", lambda s, d: _real(s, d), CUBE + _DENSE + "SELECT variant_index, SUM(CASE WHEN ds BETWEEN 0 AND 2 THEN 2 - ds END) AS total, COUNT(*) FILTER (ds BETWEEN 0 AND 2) AS n FROM g GROUP BY variant_index")


def _real(s, d):
    from ..sources import plink

    v = load(s, d).dense().variants.select("variant_index", plink.real_dosages(F.col("ds"), F.lit(False)).alias("x"))
    kept = F.filter("x", lambda y: y.isNotNull())
    return v.select("variant_index", F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda a, y: a + y)).alias("total"), F.size(kept).cast("long").alias("n"))


add("k8_export", lambda s, d: _exported(s, d), CUBE + "SELECT variant_index, ac FROM variants WHERE num_allele = 2")


def _exported(s, d):
    path = _path(s, "store")
    store.export(L.by_flag(load(s, d), F.col("num_allele") == 2).with_(calls=None), path, info=["ac"], samp=["sex"])
    return store.open_store(s, path).variants.select("variant_index", "ac")


add("r1_frequency_three_ways", lambda s, d: _ways(s, d), CUBE + COUNTS + f"SELECT variant_index, {AF0} AS calls, {AF0} AS arrays, {AF0} AS texts FROM k")


def _ways(s, d):
    ds = load(s, d)
    a = S.allele_freq(ds).withColumnRenamed("af", "calls")
    b = S.allele_freq(ds.dense(), dense=True).withColumnRenamed("af", "arrays")
    c = S.coded_counts(ds.coded()).select("variant_index", S.frequency().alias("texts"))
    return a.join(b, "variant_index").join(c, "variant_index")


add("r2_missing_rates", lambda s, d: S.missing_both(load(s, d)), CUBE + COUNTS + "SELECT 'variant' AS axis, variant_index AS ix, CAST(nm AS DOUBLE) / CAST(tot AS DOUBLE) AS missing FROM k UNION ALL SELECT 'sample', s.sample_index, CAST(COUNT(*) FILTER (c.variant_index IS NOT NULL AND a1 IS NULL) + COUNT(*) FILTER (c.variant_index IS NOT NULL AND a2 IS NULL) AS DOUBLE) / (SELECT 2e0 * COUNT(*) FROM variants) FROM samples s LEFT JOIN calls c ON c.sample_index = s.sample_index GROUP BY s.sample_index")
