"""What grows with the recorded calls and not with variants x samples: plans without laid-out cells, and the same results."""

import pytest
from pyspark.sql import functions as F

from variantloom import session
from variantloom.dataset import VariantDataset
from variantloom.operators import accessors as B
from variantloom.operators import merge as M
from variantloom.operators import mutate as X
from variantloom.operators import stats as S
from variantloom.operators import units as W
from variantloom.operators.get import get, get_text
from variantloom.plans import ploidy_queries as Q
from variantloom.plans import registry
from variantloom.sources.fixture import load

SF = "/root/testdata/sf0.001"
#: Queries whose results are as many as variants, samples or calls; before, each laid out all cells.
LINEAR = [
    "a10_dosage_freq_lists",  # F1
    "a10_dosage_freq_lists_second",  # F2
    "a11_allele_count_dense",  # F3
    "a12_dosage_count_lists",  # F4
    "a12_dosage_count_lists_second",  # F5
    "a13_af_ac_missing_dense",  # F6
    "a13_dosage_lists",  # F7
    "a2_missing_variant_dense",  # F8
    "a3_missing_sample_haploid",  # F9
    "a3_missing_sample_tetraploid",  # F10
    "a4_missing_both_haploid",  # F11
    "a4_missing_both_tetraploid",  # F12
    "a5_missing_dosage_lists",  # F13
    "a5_missing_dosage_lists_sample",  # F14
    "a6_allele_freq_dense",  # F15
    "a9_allele_freq_all_haploid",  # F16
    "a9_allele_freq_all_tetraploid",  # F17
    "d5_dosage_sparse_haploid",  # F23
    "d5_dosage_sparse_tetraploid",  # F24
    "a7_allele_freq_index1_coded",  # F27
    "a13_af_ac_missing_coded",  # F29
    "p11_format_lengths",  # F25
]


#: Queries that give a value of every cell; before, arrays of all cells were made and walked one by one.
OF_CELLS = [
    "b6_genotype_text_haploid",  # F18
    "b6_genotype_text_tetraploid",  # F19
    "d2_dosage",  # F20
    "d3_dosage_alt",  # F21
    "d4_dosage_alt2",  # F22
]


def rows(df):
    """Rows in an order of their own, numbers to twelve digits."""
    short = lambda x: float(f"{x:.12g}") if isinstance(x, float) else x
    return sorted((tuple(short(x) for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", LINEAR)
def test_no_cells_are_laid_out(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "repeat(" not in plan


@pytest.mark.parametrize("name", OF_CELLS)
def test_no_arrays_of_cells(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_repeat(" not in plan


def kept(ds):
    """The dataset with its tables computed once."""
    return ds.with_(variants=ds.variants.localCheckpoint(), samples=ds.samples.localCheckpoint(), calls=ds.calls.localCheckpoint() if ds.calls is not None else None)


def arrays(ds):
    return kept(ds.dense().with_(calls=None))


def test_recorded_lists_of_dosages(spark):
    one = kept(Q._lists(spark, SF))
    # A list longer than the alternative alleles, an empty one, none, and one with a null; a variant with all pairs recorded.
    v = spark.createDataFrame([(1, "A,C"), (2, "A,C,G"), (3, "A"), (4, "A,C")], "variant_index int, allele string")
    s = spark.createDataFrame([(1, "a"), (2, "b")], "sample_index int, sample_id string")
    c = [(1, 1, [0.5, 1.0]), (2, 1, [0.25, None]), (2, 2, None), (3, 2, []), (4, 1, [1.0, 0.5, 0.25]), (4, 2, [float("nan")])]
    calls = spark.createDataFrame([(i, j, 0, 1, False, None, d) for i, j, d in c], "variant_index int, sample_index int, a1 int, a2 int, phase boolean, dp int, ds array<double>")
    for ds in (one, VariantDataset(v, s, calls), one.filtered(samples=one.samples.where("sample_index in (2, 3, 7)"))):
        dense = arrays(ds)
        for f in (S.ds_allele_freq, S.ds_allele_count):
            for alt in (0, 1, 2):
                assert rows(f(ds, alt)) == rows(f(dense, alt))
        assert rows(S.ds_missing(ds)) == rows(S.ds_missing(dense))
        assert rows(S.ds_missing(ds, per_variant=False)) == rows(S.ds_missing(dense, per_variant=False))
        assert rows(S.ds_af_ac_missing(ds, minor=True, ns=True)) == rows(S.ds_af_ac_missing(dense, minor=True, ns=True))


@pytest.mark.parametrize("ploidy", [1, 2, 4])
def test_counts_of_calls_and_of_arrays(spark, ploidy):
    ds = kept(load(spark, SF) if ploidy == 2 else Q.dealt(spark, SF, ploidy))
    for x in (ds, ds.filtered(samples=ds.samples.where("sample_index in (1, 3, 4)"))):
        dense = arrays(x)
        texts = dense.coded()
        texts = texts.with_(variants=texts.variants.drop("gt"))
        for k in (0, 1):
            want = rows(S.allele_freq(dense, k, dense=True))
            assert want == rows(S.allele_freq(x, k)) == rows(S.allele_freq(x.dense(), k, dense=True)) == rows(S.allele_freq(texts, k))
            assert want == rows(S.coded_counts(x.coded(), S.reference_index(k)).select("variant_index", S.frequency().alias("af")))
        for f in (S.missing_both, S.all_allele_freqs, B.genotype_table):
            assert rows(f(x)) == rows(f(dense))
        for name in ("$dosage_sp", "$dosage_sp2"):
            assert rows(get(x, name)) == rows(get(dense, name))


@pytest.mark.parametrize("ploidy", [1, 2, 4])
def test_cells_and_texts_from_runs(spark, ploidy):
    ds = kept(load(spark, SF) if ploidy == 2 else Q.dealt(spark, SF, ploidy))
    for x in (ds, ds.filtered(samples=ds.samples.where("sample_index in (1, 3, 4)"))):
        dense = arrays(x)
        assert rows(B.geno(x, ["GT", "DP", "DS"])) == rows(B.geno(dense, ["GT", "DP", "DS"]))
        assert rows(x.coded().variants.select("variant_index", "gs")) == rows(dense.coded().variants.select("variant_index", "gs"))
        for name in ("$dosage", "$dosage_alt", "$dosage_alt2", "genotype", "phase", "annotation/format/DP"):
            assert rows(get_text(x, name)) == rows(get_text(dense, name))
            assert rows(get(x, name)) == rows(get(dense, name))
        for field in ("DP", "DS"):
            full = get(dense, f"annotation/format/{field}").select("variant_index", F.size(F.array_compact("value")))
            assert rows(get(x, f"annotation/format/@{field}")) == rows(full)


def test_a_table_with_a_million_samples(spark):
    """Two variants and a million samples: the texts are whole, and the runs between calls are not made cell by cell."""
    v = spark.createDataFrame([(1, "A,C"), (2, "A,C")], "variant_index int, allele string")
    n = 1_000_000
    s = spark.range(1, n + 1).select(F.col("id").cast("int").alias("sample_index"), F.col("id").cast("string").alias("sample_id"))
    c = spark.createDataFrame([(1, 1, 0, 1, False, 3, 0.5), (1, n, None, 1, True, 4, None)], "variant_index int, sample_index int, a1 int, a2 int, phase boolean, dp int, ds double")
    ds = VariantDataset(v, s, c)
    got = dict(rows(get_text(ds, "$dosage").select("variant_index", "value")))
    assert got[2] == ",".join(["2"] * n) and got[1] == ",".join(["1", *["2"] * (n - 2), "."])
    assert B.geno(ds, ["GT"]).groupBy("gt").count().collect().__len__() == 3
    assert B.geno(ds, ["GT"]).count() == 2 * n


def test_units_go_on_in_the_next_batch(spark):
    """Units cut by batches come whole to the function, each once, and they are not all in one task."""
    import pandas as pd

    v = spark.range(1, 201).select(F.col("id").cast("int").alias("variant_index"), F.col("id").alias("x"))
    u = W.create(spark, [list(range(i, i + i % 9)) for i in range(1, 101)])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        total = lambda key, f: pd.DataFrame({"unit_ix": [key[0]], "n": [len(f)], "t": [int(f["x"].sum())]})
        out = W.unit_apply(u, v, total, "unit_ix long, n long, t long")
        assert rows(out) == rows(u.where("size(index) > 0").select("unit_ix", F.size("index").cast("long"), F.aggregate("index", F.lit(0).cast("long"), lambda a, x: a + x)))
        assert rows(W.unit_apply(u, v, lambda f: f[["x"]].head(1), "x long")) == rows(u.where("size(index) > 0").select(F.array_min("index").cast("long")))
        assert out.rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_tasks_of_sample_major_are_bounded(spark, tmp_path, monkeypatch):
    """A table ten times a task's calls is sorted in ten tasks at least, each sample in one file and in order."""
    ds = load(spark, SF)
    n = ds.calls.count()
    monkeypatch.setattr(X, "CALLS_A_TASK", n // 10)
    X.sample_major(ds, str(tmp_path / "s"), 2)
    got = spark.read.parquet(str(tmp_path / "s")).withColumn("f", F.input_file_name())
    assert got.count() == n and got.groupBy("sample_index").agg(F.countDistinct("f").alias("k")).where("k > 1").isEmpty()
    assert got.select("f").distinct().count() == ds.n_samples


def test_tasks_of_merges_are_bounded(spark, monkeypatch):
    """A table twenty times a task's rows is merged in twenty tasks at least, none with many more rows than that."""
    ds = load(spark, SF)
    n = ds.calls.count()
    monkeypatch.setattr(session, "ROWS_A_TASK", n // 20)
    low = F.col("chromosome").isin("1", "2", "3")
    by_variants = [ds.filtered(variants=ds.variants.where(c)) for c in (low, ~low)]
    by_samples = [ds.filtered(samples=ds.samples.where(f"sample_index % 2 = {k}")) for k in (1, 0)]
    for m in (M.merge_variants(*by_variants), M.merge_samples(*by_samples)):
        per = [r["count"] for r in m.calls.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(per) == n and len(per) >= 15 and max(per) < 4 * n // 20
    # The samples that a file does not have count as well.
    some = ds.filtered(samples=ds.samples.where("sample_index <= 2"), variants=ds.variants.where(low))
    gaps = M.merge_variants(some, by_variants[1]).calls
    assert gaps.rdd.getNumPartitions() > 20 * (gaps.count() / n) // 2
    # The cube's calls come in tasks of that size too, unless a table this small is broadcast to the variants.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        per = [r["count"] for r in load(spark, SF).calls.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert sum(per) == n and len(per) >= 15
