"""Queries on summaries, merging, user functions, changes, accessors and files (A14-A17, B, E, G, J, K, M, R, S, U, V, X)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import vcf_text as T
from ..operators import accessors as B
from ..operators import apply as U
from ..operators import filters as L
from ..operators import matrix as G
from ..operators import merge as M
from ..operators import mutate as X
from ..operators import stats as S
from ..operators import summary as Y
from ..session import shared_dir
from ..sources import plink, store, vcf
from ..sources.fixture import CUBE, call_tasks, load
from .base import add
from .stats_queries import _ALT, _DENSE, AF0, COUNTS


def _path(s, name: str) -> str:
    """A new folder under the session's shared one."""
    return f"{shared_dir(s)}/{name}-{uuid.uuid4().hex}"


# Summaries.
add("a15_chromosome_table", lambda s, d: Y.chromosome_table(load(s, d)), CUBE + "SELECT chromosome, COUNT(*) AS n FROM variants GROUP BY chromosome")
add("a15_allele_number_table", lambda s, d: Y.allele_number_table(load(s, d)), CUBE + "SELECT num_allele, COUNT(*) AS n FROM variants GROUP BY num_allele")
add("a15_filter_table", lambda s, d: Y.filter_table(load(s, d)), CUBE + "SELECT filter, COUNT(*) AS n FROM variants GROUP BY filter")
add("a15_qual_summary", lambda s, d: Y.qual_summary(load(s, d)), CUBE + "SELECT MIN(qual) AS min, quantile_cont(qual, 0.25) AS q1, quantile_cont(qual, 0.5) AS median, avg(qual) AS mean, quantile_cont(qual, 0.75) AS q3, MAX(qual) AS max, COUNT(*) - COUNT(qual) AS missing FROM variants")
add("a14_digest", lambda s, d: Y.digest(load(s, d).variants, F.col("allele")))
add("a14_ordered_digest", lambda s, d: Y.ordered_digest(load(s, d).variants, F.col("allele")))
add("a17_combine", lambda s, d: _combined(s, d), CUBE + "SELECT CAST(SUM(ac) AS BIGINT) AS total FROM variants")


def _combined(s, d):
    ds = load(s, d)

    def part(frame):
        import pandas as pd

        return pd.DataFrame({"total": [int(frame["ac"].sum())]})

    return U.parallel(ds.with_(variants=ds.variants.select("variant_index", "ac")), part, "total long").agg(F.sum("total").alias("total"))


add("v1_summary", lambda s, d: Y.summary(load(s, d)), CUBE + """, a AS (SELECT COUNT(*) AS variants, COUNT(DISTINCT variant_id) AS variant_ids, COUNT(DISTINCT chromosome) AS chromosomes, CAST(MIN(position) AS BIGINT) AS position_min, CAST(MAX(position) AS BIGINT) AS position_max, COUNT(*) FILTER (id = '') AS blank_ids,
 (SELECT COUNT(*) FROM samples) AS samples, (SELECT COUNT(DISTINCT sample_id) FROM samples) AS sample_ids, CAST(2 AS BIGINT) AS ploidy FROM variants) SELECT name AS item, value FROM (UNPIVOT a ON COLUMNS(*) INTO NAME name VALUE value)""")
add("v1_phase_summary", lambda s, d: Y.phase_summary(load(s, d)), CUBE + "SELECT COUNT(*) FILTER (phase) AS phased, (SELECT COUNT(*) FROM samples) * (SELECT COUNT(*) FROM variants) AS cells FROM calls")
add("v2_dims", lambda s, d: _dims(s, d), CUBE + "SELECT 2 AS ploidy, (SELECT COUNT(*) FROM samples) AS samples, (SELECT COUNT(*) FROM variants) AS variants")


def _dims(s, d):
    p, n, m = load(s, d).dims()
    return s.range(1).select(F.lit(p).alias("ploidy"), F.lit(n).cast("long").alias("samples"), F.lit(m).cast("long").alias("variants"))


add("v3_check", lambda s, d: Y.check(load(s, d)).select("item", "ok"), "SELECT unnest(['variant.id is unique', 'variant.index is unique', 'sample.id is unique', 'position is not negative', 'chromosome is given', 'alleles are not empty', 'a call is recorded once', 'calls are of known samples', 'allele codes are known']) AS item, TRUE AS ok")
add("v1_field_tables", lambda s, d: Y.field_tables(load(s, d)), "SELECT * FROM (VALUES ('info', 'p_partkey', '1', 'Integer', ''), ('info', 'aa', '1', 'String', ''), ('info', 'ac', '1', 'Integer', ''), ('format', 'DP', '1', 'Integer', ''), ('format', 'DS', '1', 'Float', ''), ('sample', 'family', '1', 'String', ''), ('sample', 'sex', '1', 'String', '')) t(kind, id, number, type, description)")
add("v4_digests_on_write", lambda s, d: _kept(s, d), "SELECT name, name <> 'variants/allele' AS ok FROM (SELECT unnest(['variants/variant_id', 'variants/p_partkey', 'variants/chromosome', 'variants/position', 'variants/num_allele', 'variants/allele', 'variants/id', 'variants/qual', 'variants/filter', 'variants/aa', 'variants/ac', 'samples/sample_id', 'samples/family', 'samples/sex', 'calls/call']) AS name)")


def _kept(s, d):
    path = _path(s, "store")
    store.save(load(s, d), path, digests=True)
    back = store.open_store(s, path)
    # One allele of one variant is changed after the writing.
    changed = F.when(F.col("variant_index") == 7, F.concat("allele", F.lit("A"))).otherwise(F.col("allele"))
    return Y.check_digests(back.with_(variants=back.variants.withColumn("allele", changed)))


add("v5_system", lambda s, d: s.createDataFrame(sorted(Y.system(s).items()), "item string, value string"))
add("v6_vcf_types", lambda s, d: s.createDataFrame([(f.name, Y.vcf_type(f.dataType.simpleString())) for f in load(s, d).variants.schema.fields], "name string, type string"), "SELECT * FROM (VALUES ('variant_index', 'Integer'), ('variant_id', 'Integer'), ('p_partkey', 'Integer'), ('chromosome', 'String'), ('position', 'Integer'), ('num_allele', 'Integer'), ('allele', 'String'), ('id', 'String'), ('qual', 'Float'), ('filter', 'String'), ('aa', 'String'), ('ac', 'Integer')) t(name, type)")

# Accessors.
_END = "CAST(position + greatest(length(split_part(allele, ',', 1)), 1) - 1 AS INT)"
add("b1_granges", lambda s, d: B.granges(load(s, d)), CUBE + f'SELECT variant_id, chromosome, position AS start, {_END} AS "end" FROM variants')
add("b2_ref_alt", lambda s, d: B.ref_alt(load(s, d)).select("variant_id", "ref", F.array_join("alt", "/").alias("alt")), CUBE + f"SELECT variant_id, split_part(allele, ',', 1) AS ref, replace({_ALT}, ',', '/') AS alt FROM variants")
add("b3_fixed", lambda s, d: B.fixed(load(s, d)).select("variant_id", "ref", F.array_join("alt", "/").alias("alt"), "qual", "filter"), CUBE + f"SELECT variant_id, split_part(allele, ',', 1) AS ref, replace({_ALT}, ',', '/') AS alt, qual, filter FROM variants")
add("b4_header", lambda s, d: s.createDataFrame([(x,) for x in vcf.header_lines(load(s, d), ["aa", "ac"], [])], "line string"))
add("b5_info", lambda s, d: B.info(load(s, d), "aa").withColumnRenamed("value", "aa"), CUBE + "SELECT variant_id, NULLIF(aa, '') AS aa FROM variants")
add("b5_info_per_alt", lambda s, d: B.info(load(s, d), "ac", number="A").select("variant_id", F.posexplode("value").alias("k", "ac")), CUBE + "SELECT variant_id, CAST(k AS INT) AS k, CASE WHEN k = 0 THEN ac END AS ac FROM (SELECT variant_id, ac, unnest(range(num_allele - 1)) AS k FROM variants)")
_GT = "CASE WHEN a1 IS NULL AND a2 IS NULL THEN '.' ELSE COALESCE(CAST(a1 AS VARCHAR), '.') || CASE WHEN phase THEN '|' ELSE '/' END || COALESCE(CAST(a2 AS VARCHAR), '.') END"
add("b6_genotype_text", lambda s, d: B.geno(load(s, d), ["GT"]), CUBE + _DENSE + f"SELECT variant_index, sample_index, {_GT} AS gt FROM g")
add("b6_genotype_text_recorded", lambda s, d: B.geno(load(s, d), recorded=True), CUBE + f"SELECT variant_index, sample_index, {_GT} AS gt FROM calls")
add("b6_format_fields", lambda s, d: B.geno(load(s, d), ["DP", "DS"]), CUBE + _DENSE + "SELECT variant_index, sample_index, dp, ds FROM g")
add("b7_row_ranges", lambda s, d: B.row_ranges(load(s, d)).select("variant_id", "chromosome", "start", "end", "ref", "qual"), CUBE + f'SELECT variant_id, chromosome, position AS start, {_END} AS "end", split_part(allele, \',\', 1) AS ref, qual FROM variants')
add("b7_col_data", lambda s, d: B.col_data(load(s, d)), CUBE + "SELECT CAST(sample_index AS BIGINT) AS samples, sample_id, family, sex FROM samples")
add("k9_as_vcf", lambda s, d: B.as_vcf(load(s, d)).select("variant_id", "ref", "alt", F.array_join("gt", " ").alias("gt")), CUBE + _DENSE + f", t AS (SELECT variant_index, string_agg(COALESCE(CAST(a1 AS VARCHAR), '.') || CASE WHEN phase THEN '|' ELSE '/' END || COALESCE(CAST(a2 AS VARCHAR), '.'), ' ' ORDER BY sample_index) AS gt FROM g GROUP BY variant_index) SELECT variant_id, split_part(allele, ',', 1) AS ref, {_ALT} AS alt, gt FROM variants v JOIN t ON t.variant_index = v.variant_index")

# Merging: the cube is split and put together again.
_CALLS = "SELECT v.variant_id, s.sample_id, a1, a2, dp FROM calls c JOIN variants v ON v.variant_index = c.variant_index JOIN samples s ON s.sample_index = c.sample_index"


def _ids(m):
    samples = m.samples.select("sample_index", "sample_id")
    return m.calls.join(m.variants.select("variant_index", "chromosome", "position", "allele"), "variant_index").join(F.broadcast(samples) if m.n_samples <= 500_000 else samples, "sample_index")


def _halves(s, d):
    ds = load(s, d)
    low = F.col("variant_index") <= 50
    return L.by_flag(ds, low & (F.col("variant_index") < 10**9)), L.by_flag(ds, ~low)


def _sides(s, d):
    ds = load(s, d)
    return ds.filtered(samples=ds.samples.where("sample_index % 2 = 1")), ds.filtered(samples=ds.samples.where("sample_index % 2 = 0"))


add("j4_key_union", lambda s, d: _keys(s, d), CUBE + "SELECT DISTINCT chromosome || ':' || position || '_' || replace(allele, ',', '_') AS key FROM variants")


def _keys(s, d):
    key = C.chrom_pos_allele(F.col("chromosome"), F.col("position"), F.col("allele")).alias("key")
    a, b = _halves(s, d)
    return a.variants.select(key).unionByName(b.variants.select(key)).distinct()


add("j5_sample_alignment", lambda s, d: M.sample_union(list(_sides(s, d))).select("sample_id", "files"), CUBE + "SELECT sample_id, CAST(1 AS BIGINT) AS files FROM samples")
add("j7_allele_remap", lambda s, d: _remapped(s, d), CUBE + "SELECT variant_index, sample_index, CASE WHEN a1 = 0 THEN num_allele - 1 WHEN a1 IS NOT NULL THEN a1 - 1 END AS a1 FROM (SELECT c.variant_index, sample_index, a1, num_allele FROM calls c JOIN variants v ON v.variant_index = c.variant_index)")


def _remapped(s, d):
    ds = load(s, d)
    own = F.col("allele")
    turned = F.array_join(F.concat(F.slice(F.split(own, ","), 2, 10), F.slice(F.split(own, ","), 1, 1)), ",")
    return ds.calls.select("variant_index", "sample_index", "a1").join(ds.variants.select("variant_index", "allele"), "variant_index").select("variant_index", "sample_index", M.remap(F.col("a1"), own, turned).cast("int").alias("a1"))


add("m2_merge_variants", lambda s, d: _ids(M.merge_variants(*_two_chromosomes(s, d))).repartition(call_tasks(s, d), "chromosome", "position", "allele").groupBy("chromosome", "position", "allele", "sample_id").agg(F.sum("a1").alias("a1"), F.sum("a2").alias("a2"), F.count(F.lit(1)).alias("n")), CUBE + "SELECT chromosome, position, allele, sample_id, CAST(SUM(a1) AS BIGINT) AS a1, CAST(SUM(a2) AS BIGINT) AS a2, COUNT(*) AS n FROM calls c JOIN variants v ON v.variant_index = c.variant_index JOIN samples s ON s.sample_index = c.sample_index GROUP BY 1, 2, 3, 4")


def _two_chromosomes(s, d):
    ds = load(s, d)
    first = F.col("chromosome").isin("1", "2", "3")
    return L.by_flag(ds, first), L.by_flag(ds, ~first)


add("m3_merge_samples", lambda s, d: M.merge_samples(*_sides(s, d)).variants.select("variant_index", "chromosome", "position", "allele"), CUBE + "SELECT variant_index, chromosome, position, allele FROM variants")
add("m3_merge_samples_calls", lambda s, d: _ids(M.merge_samples(*_sides(s, d))).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("a1").alias("a1"), F.sum("a2").alias("a2")), CUBE + "SELECT sample_id, COUNT(*) AS n, CAST(SUM(a1) AS BIGINT) AS a1, CAST(SUM(a2) AS BIGINT) AS a2 FROM calls c JOIN samples s ON s.sample_index = c.sample_index GROUP BY sample_id")
add("m4_allele_union", lambda s, d: load(s, d).variants.groupBy("chromosome", "position").agg(F.array_sort(F.collect_list(F.struct("variant_index", "allele"))).alias("x")).select("chromosome", "position", M.merged_alleles(F.transform("x", lambda r: r["allele"])).alias("allele")), CUBE + ", e AS (SELECT chromosome, position, variant_index, unnest(string_split(allele, ',')) AS a, generate_subscripts(string_split(allele, ','), 1) AS k FROM variants), f AS (SELECT chromosome, position, a, MIN((variant_index, k)) AS o FROM e GROUP BY 1, 2, 3) SELECT chromosome, position, string_agg(a, ',' ORDER BY o) AS allele FROM f GROUP BY 1, 2")
add("m5_sample_annotation", lambda s, d: M.merge_samples(*_sides(s, d)).samples.select("sample_id", "family", "sex"), CUBE + "SELECT sample_id, family, sex FROM samples")
add("m7_reset_ids", lambda s, d: _renumbered(s, d), CUBE + ", a AS (SELECT variant_index, 100 + ROW_NUMBER() OVER (ORDER BY variant_index) - 1 AS variant_id FROM variants WHERE variant_index <= 50), b AS (SELECT variant_index, 150 + ROW_NUMBER() OVER (ORDER BY variant_index) - 1 AS variant_id FROM variants WHERE variant_index > 50) SELECT * FROM a UNION ALL SELECT * FROM b")


def _renumbered(s, d):
    a, b = M.reset_variant_ids(list(_halves(s, d)), start=100)
    return a.variants.select("variant_index", "variant_id").unionByName(b.variants.select("variant_index", "variant_id"))


# User functions.
add("u1_apply", lambda s, d: U.apply_variants(load(s, d), ["position", "ac"], lambda x: x["position"] * 1.0 + x["ac"]), CUBE + "SELECT variant_index, CAST(position + ac AS DOUBLE) AS value FROM variants")
add("u1_apply_relative", lambda s, d: U.apply_variants(L.by_chromosome(load(s, d), ["2"]), "ac", lambda i, x: i * 1000 + int(x), "integer", "relative"), CUBE + "SELECT variant_index, CAST(ROW_NUMBER() OVER (ORDER BY variant_index) * 1000 + ac AS BIGINT) AS value FROM variants WHERE chromosome = '2'")
add("u2_apply_samples", lambda s, d: U.apply_samples(load(s, d), _sample_depth, "sample_index int, value double"), CUBE + "SELECT sample_index, CAST(SUM(dp) AS DOUBLE) AS value FROM calls GROUP BY sample_index")


def _sample_depth(frame):
    import pandas as pd

    return pd.DataFrame({"sample_index": [frame["sample_index"].iloc[0]], "value": [float(frame["dp"].sum())]})


add("u6_par_apply", lambda s, d: s.createDataFrame([(i, v) for i, v in enumerate(U.par_apply(s, range(10), lambda x: x * x))], "i long, v long"), "SELECT i, i * i AS v FROM range(10) t(i)")

# Changes.
add("x1_add_info", lambda s, d: X.add_value(load(s, d), "annotation/info/twice", F.col("ac") * 2).variants.select("variant_index", "twice"), CUBE + "SELECT variant_index, CAST(ac * 2 AS INT) AS twice FROM variants")
add("x3_replace_chromosome", lambda s, d: X.add_value(load(s, d), "chromosome", F.concat(F.lit("chr"), "chromosome"), replace=True).variants.select("variant_index", "chromosome"), CUBE + "SELECT variant_index, 'chr' || chromosome AS chromosome FROM variants")
add("x6_add_stream", lambda s, d: X.add_stream(load(s, d), "annotation/info/sq", _squares, "long").variants.select("variant_index", "sq"), CUBE + "SELECT variant_index, CAST(ac AS BIGINT) * ac AS sq FROM variants")


def _squares(frames):
    for f in frames:
        yield f[["variant_index"]].assign(value=f["ac"].astype("int64") ** 2)


add("x7_sample_annotation", lambda s, d: X.add_value(load(s, d), "sample.annotation/rank", F.col("sample_index") * 10).samples.select("sample_id", "rank"), CUBE + "SELECT sample_id, CAST(sample_index * 10 AS INT) AS rank FROM samples")
add("x9_delete", lambda s, d: X.delete(load(s, d), info=["aa"], samp=["sex"]).variants.drop("p_partkey", "qual"), CUBE + "SELECT variant_index, variant_id, chromosome, position, num_allele, allele, id, filter, ac FROM variants")


add("x10_sample_major", lambda s, d: _sample_major(s, d), CUBE + "SELECT sample_index, COUNT(*) AS n, CAST(SUM(dp) AS BIGINT) AS dp FROM calls GROUP BY sample_index")


def _sample_major(s, d):
    path = _path(s, "by-sample")
    X.sample_major(load(s, d), path, 8)
    return s.read.parquet(path).groupBy("sample_index").agg(F.count(F.lit(1)).alias("n"), F.sum("dp").alias("dp"))


# Matrices.
_D4 = "CASE WHEN a1 IS NOT NULL OR a2 IS NOT NULL THEN COALESCE((a1 <> 0)::INT, 0) + COALESCE((a2 <> 0)::INT, 0) ELSE 3 END"
add("g1_pack_by_variant", lambda s, d: G.pack_by_variant(load(s, d)).select("variant_index", F.lower(F.hex("packed")).alias("packed")), CUBE + _DENSE + f", c AS (SELECT variant_index, (sample_index - 1) // 4 AS b, SUM({_D4} << CAST(2 * ((sample_index - 1) % 4) AS INT)) + CASE COUNT(*) WHEN 1 THEN 252 WHEN 2 THEN 240 WHEN 3 THEN 192 ELSE 0 END AS v FROM g GROUP BY 1, 2) SELECT variant_index, string_agg(lpad(lower(hex(v::INT)), 2, '0'), '' ORDER BY b) AS packed FROM c GROUP BY variant_index")
add("g1_pack_native", lambda s, d: G.pack_by_variant_native(load(s, d)), CUBE + _DENSE + f", c AS (SELECT variant_index, (sample_index - 1) // 4 AS b, SUM({_D4} << CAST(2 * ((sample_index - 1) % 4) AS INT)) + CASE COUNT(*) WHEN 1 THEN 252 WHEN 2 THEN 240 WHEN 3 THEN 192 ELSE 0 END AS v FROM g GROUP BY 1, 2) SELECT variant_index, string_agg(lpad(lower(hex(v::INT)), 2, '0'), '' ORDER BY b) AS packed_hex FROM c GROUP BY variant_index")
add("g2_pack_by_sample", lambda s, d: G.pack_by_sample(load(s, d)), CUBE + _DENSE + f"SELECT sample_index, CAST((variant_index - 1) // 4 AS BIGINT) AS block, CAST(SUM({_D4} << CAST(2 * ((variant_index - 1) % 4) AS INT)) + CASE COUNT(*) WHEN 1 THEN 252 WHEN 2 THEN 240 WHEN 3 THEN 192 ELSE 0 END AS INT) AS packed FROM g GROUP BY 1, 2")

# Files.
add("s6_vcf_round_trip", lambda s, d: _vcf_back(s, d), CUBE + _DENSE + ", t AS (SELECT variant_index, string_agg(COALESCE(CAST(a1 AS VARCHAR), '.') || ',' || COALESCE(CAST(a2 AS VARCHAR), '.'), ',' ORDER BY sample_index) AS gt FROM g GROUP BY variant_index) SELECT v.variant_index, chromosome, position, allele, id, filter, COALESCE(aa, '') AS aa, ac, gt FROM variants v JOIN t ON t.variant_index = v.variant_index")


def _vcf_back(s, d):
    path = _path(s, "vcf")
    vcf.write_vcf(load(s, d), path, info=["aa", "ac"], fmt=[])
    got = vcf.read_vcf(s, *_parts(s, path))
    return got.variants.select("variant_index", "chromosome", "position", "allele", "id", "filter", "aa", "ac", F.array_join(F.transform("gt", lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",").alias("gt"))


def _parts(s, path: str) -> list[str]:
    """A folder of parts made into one file name for readers: parts in order, header lines only in the first."""
    lines = vcf.numbered_lines(s, sorted(s.read.text(path).inputFiles()), None).orderBy("line_ix").select("value")
    one = path + "-one"
    lines.coalesce(1).write.text(one)
    return [one]


add("k1_vcf_lines", lambda s, d: vcf.vcf_lines(X.add_value(load(s, d), "annotation/qual", F.lit(None).cast("double"), replace=True), info=["ac", "aa"], fmt=["dp"]), CUBE + _DENSE + """, t AS (SELECT variant_index, bool_or(dp IS NOT NULL) AS some_dp, string_agg(COALESCE(CAST(a1 AS VARCHAR), '.') || CASE WHEN phase THEN '|' ELSE '/' END || COALESCE(CAST(a2 AS VARCHAR), '.') || ':' || COALESCE(CAST(dp AS VARCHAR), '.'), chr(9) ORDER BY sample_index) AS gt,
 string_agg(COALESCE(CAST(a1 AS VARCHAR), '.') || CASE WHEN phase THEN '|' ELSE '/' END || COALESCE(CAST(a2 AS VARCHAR), '.'), chr(9) ORDER BY sample_index) AS bare FROM g GROUP BY variant_index)
 SELECT v.variant_index, concat_ws(chr(9), chromosome, position, CASE WHEN id = '' THEN '.' ELSE id END, split_part(allele, ',', 1), CASE WHEN strpos(allele, ',') > 0 THEN substr(allele, strpos(allele, ',') + 1) ELSE '.' END,
 '.', COALESCE(filter, '.'), 'ac=' || ac || CASE WHEN aa IS NULL THEN '' ELSE ';aa=' || aa END, CASE WHEN some_dp THEN 'GT:DP' ELSE 'GT' END, CASE WHEN some_dp THEN gt ELSE bare END) AS value FROM variants v JOIN t ON t.variant_index = v.variant_index""")
add("s10_plink_round_trip", lambda s, d: _bed_back(s, d), CUBE + _DENSE + ", t AS (SELECT variant_index, string_agg(CASE WHEN a1 IS NULL OR a2 IS NULL THEN '.' ELSE CAST((a1 <> 0)::INT + (a2 <> 0)::INT AS VARCHAR) END, ',' ORDER BY sample_index) AS alt FROM g GROUP BY variant_index) SELECT v.variant_index, chromosome, position, alt FROM variants v JOIN t ON t.variant_index = v.variant_index")


def _bed_back(s, d):
    path = _path(s, "bed") + "/set"
    plink.write_bed(load(s, d), path)
    got = plink.read_bed(s, f"{path}.bed", f"{path}.bim", f"{path}.fam")
    alt = F.array_join(F.transform(C.dosage_alt(F.col("gt")), lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",").alias("alt")
    return got.variants.select("variant_index", "chromosome", "position", alt)


add("s11_dosage_round_trip", lambda s, d: _snp_back(s, d), CUBE + _DENSE + ", t AS (SELECT variant_index, string_agg(CASE WHEN a1 IS NULL OR a2 IS NULL THEN '.' ELSE CAST((a1 = 0)::INT + (a2 = 0)::INT AS VARCHAR) END, ',' ORDER BY sample_index) AS ref FROM g GROUP BY variant_index) SELECT variant_index, ref FROM t")


def _snp_back(s, d):
    ds = load(s, d)
    got = plink.from_dosages(plink.to_dosages(ds), ds.samples, major_ref=False)
    return got.variants.select("variant_index", F.array_join(F.transform(C.dosage(F.col("gt")), lambda x: F.coalesce(x.cast("string"), F.lit("."))), ",").alias("ref"))


add("k7_dosages", lambda s, d: plink.to_dosages(load(s, d)).select("variant_index", "allele", F.array_join(F.transform("dosage", lambda x: x.cast("string")), "").alias("dosage")), CUBE + _DENSE + ", t AS (SELECT variant_index, string_agg(CASE WHEN a1 IS NULL OR a2 IS NULL THEN '3' ELSE CAST((a1 = 0)::INT + (a2 = 0)::INT AS VARCHAR) END, '' ORDER BY sample_index) AS dosage FROM g GROUP BY variant_index) SELECT v.variant_index, CASE WHEN strpos(allele, ',') > 0 THEN split_part(allele, ',', 1) || '/' || substr(allele, strpos(allele, ',') + 1) ELSE allele END AS allele, dosage FROM variants v JOIN t ON t.variant_index = v.variant_index")
add("k6_bim", lambda s, d: plink.bim_lines(load(s, d)), CUBE + f"SELECT variant_index, concat_ws(chr(9), chromosome, CASE WHEN id = '' THEN '.' ELSE id END, '0', position, CASE WHEN {_ALT} = '' THEN '0' ELSE replace({_ALT}, ',', '/') END, split_part(allele, ',', 1)) AS value FROM variants")
add("k6_fam", lambda s, d: plink.fam_lines(load(s, d)), CUBE + "SELECT sample_index, concat_ws(chr(9), '0', sample_id, '0', '0', CASE sex WHEN 'M' THEN '1' ELSE '2' END, '-9') AS value FROM samples")
add("k8_store_round_trip", lambda s, d: _store_back(s, d), CUBE + COUNTS + f"SELECT variant_index, {AF0} AS af FROM k WHERE chromosome IN ('3', 'X')")


def _store_back(s, d):
    path = _path(s, "store")
    store.save(load(s, d), path)
    return S.allele_freq(L.by_chromosome(store.open_store(s, path), ["3", "X"]))


add("s13_empty", lambda s, d: store.empty(s, ["a", "b"], 3).variants.drop("qual"), "SELECT CAST(i AS INT) AS variant_index, i AS variant_id, '' AS chromosome, 0 AS position, '' AS allele, '' AS id, 'PASS' AS filter FROM range(1, 4) t(i)")
add("e_vcf_numbers", lambda s, d: load(s, d).variants.select("variant_index", T.general(F.col("qual")).alias("qual")))

# Recipes.
add("r4_inbreeding", lambda s, d: G.inbreeding(load(s, d)), CUBE + COUNTS + _DENSE + f", p AS (SELECT variant_index, {AF0} AS p FROM k), h AS (SELECT sample_index, CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN CAST((a1 = 0)::INT + (a2 = 0)::INT AS DOUBLE) END AS d, p FROM g JOIN p ON p.variant_index = g.variant_index WHERE p > 0 AND p < 1) SELECT sample_index, AVG((d * d - d * (1 + 2 * p) + 2 * p * p) / (2 * p * (1 - p))) AS f FROM h GROUP BY sample_index")
add("r5_genotype_table", lambda s, d: B.genotype_table(load(s, d)), CUBE + _DENSE + "SELECT CASE WHEN a1 IS NOT NULL AND a2 IS NOT NULL THEN a1 || '/' || a2 END AS gt, COUNT(*) AS n FROM g GROUP BY 1")


add("r6_rare_passed", lambda s, d: _rare(s, d, "filter = 'PASS'"), CUBE + COUNTS + f"SELECT k.variant_index, {AF0} AS af FROM k JOIN variants v ON v.variant_index = k.variant_index WHERE v.filter = 'PASS' AND {AF0} < 0.9e0")


def _rare(s, d, flag):
    ds = load(s, d)
    flagged = ds.variants.where(flag).select("variant_index")
    return S.allele_freq(ds.filtered(variants=ds.variants.join(flagged, "variant_index", "left_semi"))).where("af < 0.9")


add("r7_region_export", lambda s, d: vcf.vcf_lines(L.by_ranges(load(s, d), [("chr1", 1000, 3000)]), info=[], fmt=[]).select("variant_index", F.substring_index("value", "\t", 5).alias("head")), CUBE + "SELECT variant_index, concat_ws(chr(9), chromosome, position, CASE WHEN id = '' THEN '.' ELSE id END, split_part(allele, ',', 1), CASE WHEN strpos(allele, ',') > 0 THEN substr(allele, strpos(allele, ',') + 1) ELSE '.' END) AS head FROM variants WHERE chromosome = '1' AND position BETWEEN 1000 AND 3000")
add("r3_components", lambda s, d: _pca(s, d))


def _pca(s, d):
    values, vectors = G.principal_components(load(s, d), 2)
    return s.createDataFrame([(i + 1, k + 1, float(values[k]), float(vectors[i, k])) for i in range(len(vectors)) for k in range(len(values))], "sample int, component int, eigenvalue double, loading double")
