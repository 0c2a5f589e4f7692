"""Identities, hand-written files and edge cases of the engine."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from variantloom.dataset import VariantDataset
from variantloom.functions import columns as C
from variantloom.functions import vcf_text as T
from variantloom.operators import apply as U
from variantloom.operators import filters as L
from variantloom.operators import matrix as G
from variantloom.operators import merge as M
from variantloom.operators import mutate as X
from variantloom.operators import stats as S
from variantloom.operators import summary as Y
from variantloom.operators import units as W
from variantloom.sources import fixture, plink, store, vcf
from variantloom.streaming import vcf_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def ds(spark):
    return fixture.load(spark, SF)


def values(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_sparse_and_dense_agree(ds):
    assert values(S.allele_freq(ds), "variant_index", "af") == values(S.allele_freq(ds.dense(), dense=True), "variant_index", "af")


def test_dosage_identity(ds):
    d = ds.dense().variants.select(C.dosage(F.col("gt")).alias("a"), C.dosage_alt(F.col("gt")).alias("b"), C.dosage_alt2(F.col("gt")).alias("c")).collect()
    for r in d:
        for a, b, c in zip(r["a"], r["b"], r["c"], strict=True):
            assert (a is None) == (b is None)
            assert a is None or a + b == 2 and c == b


def test_genotypes_against_numpy(ds):
    calls = ds.calls.toPandas()
    n = ds.n_samples
    g = np.zeros((ds.n_variants, n, 2))
    for r in calls.itertuples():
        g[r.variant_index - 1, r.sample_index - 1] = [np.nan if pd.isna(r.a1) else r.a1, np.nan if pd.isna(r.a2) else r.a2]
    got = {r["variant_index"]: r["gt"] for r in ds.dense().variants.select("variant_index", "gt").collect()}
    for i in range(len(g)):
        assert [None if np.isnan(x) else int(x) for x in g[i].ravel()] == got[i + 1]


def test_all_missing_site(spark):
    v = spark.createDataFrame([(1, "A,C", [None, None, None, None]), (2, "A,C", [0, 1, None, 5])], "variant_index int, allele string, gt array<int>")
    d = VariantDataset(v, spark.createDataFrame([(1, "a"), (2, "b")], "sample_index int, sample_id string"))
    r = {x["variant_index"]: x for x in S.af_ac_missing(d, ns=True, dense=True).collect()}
    assert (r[1]["af"], r[1]["ac"], r[1]["miss"], r[1]["ns"]) == (None, None, 1.0, 0)
    # A code beyond the alleles counts in the denominator.
    assert r[2]["af"] == pytest.approx(1 / 3) and r[2]["ns"] == 2


def test_dosage_matrix(spark):
    d = spark.createDataFrame([([[0.5, None, 1.5], [0.0, 0.25, None]],), ([[None, None, None]] * 2,)], "m array<array<double>>")
    got = [tuple(r) for r in d.select(S.dosage_matrix_freq(F.col("m"), 2, 0, 2), S.dosage_matrix_freq(F.col("m"), 2, 1), S.dosage_matrix_freq(F.col("m"), 2, 2)).collect()]
    assert got[0] == (pytest.approx(1 - 2.25 * 2 / (4 * 2)), pytest.approx(2.0 / 4), pytest.approx(0.25 / 4)) and got[1] == (None, None, None)


def test_num_allele_rejects_empty_alleles(spark):
    ok = spark.createDataFrame([("",), ("A",), ("A,C",), ("A,",)], "a string").select(C.num_allele(F.col("a"))).collect()
    assert [r[0] for r in ok] == [0, 1, 2, 2]
    with pytest.raises(Exception, match="empty allele"):
        spark.createDataFrame([(",A",)], "a string").select(C.num_allele(F.col("a"))).collect()


def test_filter_stack(ds):
    f = L.FilterStack(ds)
    f.push()
    f.set(L.by_chromosome(f.current, ["1"]))
    inner = f.current.n_variants
    f.pop()
    assert f.current.n_variants == ds.n_variants > inner
    with pytest.raises(IndexError):
        f.pop()


def test_merged_ranges():
    assert L.merged_ranges([("1", 5, 9), ("1", 10, 12), ("1", 20, 15), ("2", None, None), ("1", 6, 7)]) == [("1", 5, 12), ("1", 20, 20), ("2", 0, L.MAX_POSITION)]


def test_range_join_equals_expressions(ds):
    r = [(str(k % 22 + 1), 1000 + 50 * k, 1000 + 50 * k + 700) for k in range(40)]
    many = ds.spark.createDataFrame(r, "c string, lo long, hi long")
    assert sorted(values(L.by_ranges(ds, r).variants, "variant_index", "position")) == sorted(values(L.by_ranges(ds, many).variants, "variant_index", "position"))


def test_position_cases(spark):
    v = spark.createDataFrame([(1, "1", 10, "A,C"), (2, "1", 10, "A,G"), (3, "2", 10, "T"), (4, "1", 20, "A,C")], "variant_index int, chromosome string, position int, allele string")
    d = VariantDataset(v, spark.createDataFrame([], "sample_index int, sample_id string"))
    q = spark.createDataFrame([(1, "1", 10, None, None), (2, "1", 10, "A", "G"), (3, "2", 10, "T", "C"), (4, "9", 10, None, None), (5, "2", 10, "T", None), (6, "1", 10, "A", "G")], "query_ix long, chromosome string, position int, ref string, alt string")
    assert sorted(values(L.by_positions(d, q).variants, "variant_index", "position")) == [1, 2, 3]
    assert sorted(values(L.by_positions(d, q, multi=False).variants, "variant_index", "position")) == [1, 2, 3]
    assert values(L.position_index(d, q), "query_ix", "place") == {1: 1, 2: 2, 3: None, 4: None, 5: 3, 6: 2}
    with pytest.raises(ValueError):
        L.by_positions(d, q.drop("alt"))


def test_position_queries_over_all_orders(spark):
    from variantloom.plans import registry

    orders = {r[0] for r in spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey").collect()}
    assert len([k for k in orders if k >= 500]) > 0
    for name in ("j1_position_matches", "f12_position_index", "f8_request_index"):
        got = registry.QUERIES[name](spark, SF)
        assert {r[0] for r in got.select("request_ix" if name.startswith("f8") else "query_ix").collect()} == orders


def test_windows(spark):
    v = spark.createDataFrame([(i + 1, "1", p) for i, p in enumerate([1, 4999, 5000, 7500, 20000])], "variant_index int, chromosome string, position int")
    got = [(r["start"], r["index"]) for r in W.sliding_windows(v).orderBy("start").collect()]
    assert got == [(0, [1, 2]), (2500, [2, 3]), (5000, [3, 4]), (7500, [4]), (17500, [5])]
    every = W.sliding_windows(v, dup_rm=False).orderBy("start").collect()
    assert [r["start"] for r in every] == list(range(0, every[-1]["start"] + 1, 2500)) and every[-1]["index"] == [5]


def test_unit_difference_by_name(spark):
    a = W.create(spark, [[1, 2, 3], [4, 5]], ["chr1", "chr1"])
    b = W.create(spark, [[2], [4]], ["chr1", "chr1"])
    assert [r["index"] for r in W.set_diff(a, b, by_name=True).orderBy("unit_ix").collect()] == [[1, 3], [4, 5]]


def test_merge_back(spark, ds):
    a, b = ds.filtered(samples=ds.samples.where("sample_index <= 4")), ds.filtered(samples=ds.samples.where("sample_index > 4"))
    m = M.merge(a, b)
    assert m.dims() == ds.dims()
    assert values(S.allele_freq(m), "variant_index", "af") == values(S.allele_freq(ds), "variant_index", "af")
    with pytest.raises(ValueError):
        M.merge_variants(ds, ds)


def test_merge_variants_fills_absent_samples(ds):
    a = L.by_chromosome(ds, ["1"]).filtered(samples=ds.samples.where("sample_index <= 6"))
    b = L.by_chromosome(ds, ["2"])
    m = M.merge(b, a)
    got = m.calls.join(m.samples, "sample_index").where(F.col("variant_index") > b.n_variants).where(F.col("sample_id").isin([r[0] for r in ds.samples.where("sample_index > 6").select("sample_id").collect()]))
    assert got.count() == a.n_variants * 4 and got.where("a1 is not null or a2 is not null").count() == 0


def test_changes(ds):
    with pytest.raises(ValueError):
        X.add_value(ds, "position", F.lit(1))
    with pytest.raises(ValueError):
        X.add_value(ds, "variant.id", F.lit(1))
    with pytest.raises(KeyError):
        X.delete(ds, info=["nothing"])
    n = ds.n_variants
    got = X.add_value(ds, "annotation/info/mark", list(range(n)), kind="int")
    assert values(got.variants, "variant_index", "mark") == {i + 1: i for i in range(n)}


def test_apply_family(spark, ds):
    assert values(U.apply_variants(ds, "allele", len, "integer"), "variant_index", "value") == values(ds.variants.withColumn("n", F.length("allele")), "variant_index", "n")
    parts = U.parallel(ds.with_(variants=ds.variants.select("variant_index", "ac")), lambda f: pd.DataFrame({"t": [int(f["ac"].sum())]}), "t long", parts=3)
    assert U.combine(parts, "t") == U.combine(parts, "t", lambda a, b: a + b) == sum(values(ds.variants, "variant_index", "ac").values())


def test_digest_is_bound_to_values_and_places(ds):
    one = lambda v: Y.digest(v, F.col("allele")).first()["md5"]
    v = ds.variants.cache()
    assert one(v) == one(v.repartition(7))
    assert one(v) != one(v.withColumn("variant_index", F.col("variant_index") + 1))
    assert one(v) != one(v.where("variant_index > 1"))


def test_check_finds_faults(spark, ds):
    bad = ds.with_(variants=ds.variants.withColumn("variant_id", F.lit(1).cast("long")))
    assert {r["item"]: r["ok"] for r in Y.check(bad).collect()}["variant.id is unique"] is False


VCF = """##fileformat=VCFv4.2
##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth, total">
##INFO=<ID=HM,Number=0,Type=Flag,Description="In map">
##INFO=<ID=AC,Number=A,Type=Integer,Description="Count">
##INFO=<ID=AD,Number=R,Type=Integer,Description="Depths">
##INFO=<ID=GP,Number=G,Type=Float,Description="Probabilities">
##INFO=<ID=XX,Number=.,Type=String,Description="Any">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=DP,Number=.,Type=Integer,Description="Depth">
##contig=<ID=1,length=1000>
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2
chr1\t100\trs1\tA\tC\t30.5\tPASS\tDP=7;HM;AC=3;AD=1,2;GP=0.1,0.2,0.7;ZZ=9;DP=8\tGT:DP\t0|1:3\t./.:.
1\t200\t.\tG\tT,C\t.\t.\tAC=1;XX=a,.,b\tGT\t1/2\t0
Chr2\t300\tx\t.\t.\t1e3\tq10\t.\tGT\t0/0/1\t.|1
"""


def test_vcf_reader(spark, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text(VCF)
    h = vcf.read_header(spark, str(p))
    assert h.samples == ["s1", "s2"] and h.info["DP"]["Description"] == "Depth, total" and h.ploidy == 2
    d = vcf.read_vcf(spark, str(p), prefixes=("chr",))
    r = d.variants.orderBy("variant_index").collect()
    assert [x["chromosome"] for x in r] == ["1", "1", "2"] and [x["allele"] for x in r] == ["A,C", "G,T,C", "."]
    assert [x["id"] for x in r] == ["rs1", "", "x"] and [x["qual"] for x in r] == [30.5, None, 1000.0] and [x["filter"] for x in r] == ["PASS", None, "q10"]
    assert [x["DP"] for x in r] == [7, None, None] and [x["HM"] for x in r] == [True, False, False]
    assert [x["AC"] for x in r] == [[3], [1, None], []] and r[0]["GP"] == [0.1, 0.2, 0.7] and r[1]["XX"] == ["a", "", "b"]
    assert [x["gt"] for x in r] == [[0, 1, None, None], [1, 2, 0, None], [0, 0, None, 1]] and r[0]["phase"] == [True, False]
    assert r[0]["fmt_DP"] == [[3], [None]] and r[1]["fmt_DP"] is None
    assert [(x["sample_index"], x["alleles"]) for x in r[2]["geno_extra"]] == [(1, [1])]
    assert vcf.read_vcf(spark, str(p), start=2, count=1).variants.select("position").collect()[0][0] == 200
    assert vcf.count_rows(spark, str(p)) == 3
    with pytest.raises(ValueError):
        vcf.parse_header(["##fileformat=VCFv3.3"])
    p.write_text(VCF.replace("AC=3;", "AC=3,4;"))
    with pytest.raises(Exception, match="more values"):
        vcf.read_vcf(spark, str(p)).variants.collect()


def test_ploidy():
    row = lambda *g: "\t".join(["1", "1", ".", "A", "C", ".", ".", ".", "GT", *g])
    assert [vcf.infer_ploidy(row(*g)) for g in (["0", "0/1"], ["0/0/1", "0/1"], ["0/0/1", "0/1/1", "0"], ["0,1/0/0/0/0", "1"])] == [2, 2, 4, 2]


def test_vcf_text(spark):
    x = spark.createDataFrame([(0.25,), (1e-5,), (123456.0,), (1234567.0,), (100.0,), (0.0,), (None,), (-2.5,), (0.0001,)], "x double")
    assert [r[0] for r in x.select(T.general(F.col("x"))).collect()] == ["0.25", "1e-05", "123456", "1.23457e+06", "100", "0", ".", "-2.5", "0.0001"]
    y = spark.createDataFrame([([1, None, 3, None],), ([None],), ([],)], "x array<int>")
    assert [r[0] for r in y.select(T.list_text(F.col("x"), "int")).collect()] == ["1,.,3", None, None]


def test_bed(spark, tmp_path):
    codes = np.array([[0, 1, 2, 3, 0], [3, 3, 3, 2, 1], [1, 1, 0, 0, 2]])
    data = plink.MAGIC + b"\x01" + b"".join(G.pack_crumbs(r.astype(np.uint8)) for r in codes)
    assert (plink.decode_bed(data, 5, 3) == codes).all()
    turned = plink.MAGIC + b"\x00" + b"".join(G.pack_crumbs(r.astype(np.uint8)) for r in codes.T)
    assert (plink.decode_bed(turned, 5, 3) == codes).all()
    for pack in (__import__("gzip").compress, __import__("lzma").compress):
        assert (plink.decode_bed(pack(data), 5, 3) == codes).all()
    (tmp_path / "a.bed").write_bytes(data)
    (tmp_path / "a.bim").write_text("1 a 0 10 A G\n23 b 0 20 C T\n26 c 0 30 G A\n")
    (tmp_path / "a.fam").write_text("f1 i 0 0 1 2\nf2 i 0 0 2 1\nf3 j 0 0 0 -9\nf4 k 0 0 1 1\nf5 l 0 0 1 1\n")
    d = plink.read_bed(spark, *(str(tmp_path / f"a.{x}") for x in ("bed", "bim", "fam")))
    r = d.variants.orderBy("variant_index").collect()
    assert [x["chromosome"] for x in r] == ["1", "X", "MT"] and r[0]["allele"] == "G,A"
    assert r[0]["gt"] == [1, 1, None, None, 1, 0, 0, 0, 1, 1]
    assert [x["sample_id"] for x in d.samples.orderBy("sample_index").collect()] == ["f1-i", "f2-i", "j", "k", "l"]
    with pytest.raises(ValueError):
        plink.decode_bed(b"xx\x01", 1, 1)


def test_store(spark, ds, tmp_path):
    p = str(tmp_path / "s")
    store.save(L.by_chromosome(ds, ["1", "Y"]), p, "zip")
    back = store.open_store(spark, p)
    assert back.n_variants == L.by_chromosome(ds, ["1", "Y"]).n_variants and back.n_samples == ds.n_samples
    assert store.export(ds, str(tmp_path / "t"), info=["ac", "none"]) == ["none"]
    with pytest.raises(ValueError):
        store.save(ds, p, "unknown")


def test_gram_against_numpy(ds):
    d = L.by_chromosome(ds, ["1", "2", "3"])
    g = np.array([[np.nan if x is None else x for x in r[0]] for r in d.dense().variants.select(C.dosage(F.col("gt"))).collect()])
    m = np.nanmean(g, axis=1)
    p = m / 2
    z = np.where(np.isnan(g), 0, g - m[:, None])
    with np.errstate(divide="ignore", invalid="ignore"):
        w = 1 / (p * (1 - p))
    ok = np.isfinite(w)
    want = (z[ok] * w[ok, None]).T @ z[ok]
    want *= len(want) / np.trace(want)
    assert np.allclose(G.gram(d), want)


def test_components_of_the_whole_cube(spark, ds):
    from variantloom.plans import registry

    got = {(r["sample"], r["component"]): r for r in registry.QUERIES["r3_components"](spark, SF).collect()}
    values, vectors = G.principal_components(ds, 2)
    assert len(got) == 2 * ds.samples.count() == 2 * len(vectors)
    assert np.allclose([got[1, k]["eigenvalue"] for k in (1, 2)], values)


def test_sample_major_over_all_samples(spark, ds):
    from variantloom.plans import registry

    assert registry.QUERIES["x10_sample_major"](spark, SF).count() == ds.selected_calls.select("sample_index").distinct().count()


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.vcf").write_text(VCF)
    q = vcf_stream.read_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("vcf_drop").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("vcf_drop").count() == 3


def test_empty_dataset(spark):
    e = store.empty(spark, ["a", "b"], 2)
    assert e.dims() == (2, 2, 2) and values(S.allele_freq(e), "variant_index", "af") == {1: 1.0, 2: 1.0}
    none = e.filtered(variants=e.variants.limit(0))
    assert S.af_ac_missing(none).count() == 0 and W.sliding_windows(none.variants).count() == 0


def test_chromosome_runs_that_alternate(spark):
    names = ["1", "1", "2", "2", "1", "3", "1", "1"]
    v = spark.createDataFrame([(10 * i + 1, c) for i, c in enumerate(names)], "variant_index int, chromosome string")
    assert [(r["chromosome"], r["length"]) for r in C.chromosome_runs(v).orderBy("run").collect()] == [("1", 2), ("2", 2), ("1", 1), ("3", 1), ("1", 2)]


def test_numbering_across_blocks(spark):
    rows = spark.range(0, 400_000, 7).select(F.col("id").alias("variant_index"))
    got = L.numbered(rows, "variant_index").where("_rank - 1 <> variant_index / 7").count()
    assert got == 0



def test_get_by_name(spark, ds):
    from variantloom.operators.get import get, get_many
    from variantloom.session import block_size, set_workers, workers

    d = fixture.load(spark, SF, info=True)
    names = ["variant.id", "position", "chromosome", "allele", "annotation/id", "annotation/qual", "annotation/filter", "genotype", "phase", "$dosage", "$dosage_alt", "$dosage_alt2", "$num_allele", "$ref", "$alt", "$chrom_pos", "$chrom_pos2", "$chrom_pos_allele", "$variant_index", "@genotype", "annotation/info/aa", "annotation/info/@aa", "annotation/info/bn", "annotation/info/@bn", "annotation/format/DP", "annotation/format/@DP"]
    assert all(get(d, n).count() == d.n_variants for n in names)
    assert get(d, "sample.id").count() == get(d, "sample.annotation/sex").count() == get(d, "$sample_index").count() == d.n_samples
    assert values(get(d, "annotation/info/@bn"), "variant_index", "value") == values(d.variants.withColumn("n", F.size("bn")), "variant_index", "n")
    x = d.variants.select("variant_index", (F.col("ac") * 3).alias("score"))
    assert values(get(d, "$:score", {"score": x}), "variant_index", "value") == values(x, "variant_index", "score")
    assert get(d, "$dosage_sp").columns == ["sample_index", "variant_index", "value"] and get(d, "$chromosome").columns == ["run", "chromosome", "length"]
    assert get_many(d, ["position", "$ref"]).columns == ["variant_index", "position", "$ref"]
    for n in ("$nothing", "annotation/info/none", "sample.annotation/none"):
        with pytest.raises(KeyError):
            get(d, n)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert set_workers(spark, int(before)) == int(before) and workers(spark) >= 1 and block_size(100, 4) == 9


def test_genotype_texts(spark, ds):
    a = {r["variant_index"]: r["gs"] for r in ds.coded().variants.select("variant_index", "gs").collect()}
    b = {r["variant_index"]: r["gs"] for r in ds.dense().coded().variants.select("variant_index", "gs").collect()}
    assert a == b and {len(x) for x in a.values()} == {2 * ds.n_samples}
    some = ds.filtered(samples=ds.samples.where("sample_index in (2, 5)"))
    cut = ds.coded().filtered(samples=ds.samples.where("sample_index in (2, 5)"))
    assert values(cut.variants, "variant_index", "gs") == values(some.coded().variants, "variant_index", "gs")
    assert values(some.coded().variants, "variant_index", "gs") == values(some.dense().coded().variants, "variant_index", "gs")
    v = spark.createDataFrame([(1, "A", [0, 11, None, 61])], "variant_index int, allele string, gt array<int>")
    d = VariantDataset(v, spark.createDataFrame([(1, "a"), (2, "b")], "sample_index int, sample_id string")).coded()
    assert d.variants.first()["gs"] == "0B.z"
    assert S.coded_counts(d, F.lit(11)).first()["n_allele"] == 1


def test_operators_on_a_vcf_dataset(spark, ds, tmp_path):
    p = tmp_path / "a.vcf"
    p.write_text(VCF)
    d = vcf.read_vcf(spark, str(p))
    assert values(S.allele_freq(d), "variant_index", "af") == {1: 0.5, 2: pytest.approx(1 / 3), 3: pytest.approx(2 / 3)}
    assert values(S.missing_per_sample(d), "sample_index", "missing") == {1: 0.0, 2: pytest.approx(4 / 6)}
    assert [r["counts"] for r in S.all_allele_counts(d).orderBy("variant_index").collect()] == [[1, 1], [1, 1, 1], [2]]
    arrays = ds.dense().with_(calls=None)
    key = lambda r: (r["variant_index"], r["sample_index"], r["a1"], r["a2"])
    plain = lambda df: sorted(map(repr, map(key, df.where("a1 is null or a2 is null or a1 <> 0 or a2 <> 0").collect())))
    assert plain(arrays.selected_calls) == plain(ds.calls)
    assert values(S.missing_per_sample(arrays), "sample_index", "missing") == values(S.missing_per_sample(ds), "sample_index", "missing")
    few = arrays.filtered(samples=ds.samples.where("sample_index in (3, 8)"))
    assert plain(few.selected_calls) == plain(ds.calls.where("sample_index in (3, 8)"))


@pytest.mark.parametrize("module", ["stats_queries", "filter_queries", "table_queries", "more_queries", "registry"])
def test_query_modules_import_alone(module):
    """As a Python worker imports them."""
    import subprocess
    import sys

    subprocess.run([sys.executable, "-c", f"import variantloom.plans.{module}"], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
