"""VCF fields and codes that need care, other ploidies read from files, and merges of arrays."""

import gzip

import pytest
from pyspark.sql import functions as F

from variantloom.operators import accessors as B
from variantloom.operators import apply as U
from variantloom.operators import merge as M
from variantloom.operators import mutate as X
from variantloom.operators import stats as S
from variantloom.sources import vcf

HEAD = """##fileformat=VCFv4.2
##INFO=<ID=ID,Number=1,Type=String,Description="x">
##INFO=<ID=id,Number=1,Type=String,Description="x">
##INFO=<ID=A.B,Number=1,Type=Integer,Description="x">
##INFO=<ID=GT,Number=1,Type=Integer,Description="x">
##FORMAT=<ID=GT,Number=1,Type=String,Description="x">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="x">
"""


def read(spark, tmp_path, samples, *rows, name="a.vcf", **k):
    p = tmp_path / name
    cols = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]
    p.write_text(HEAD + "\t".join(cols) + "\n" + "".join("\t".join(r) + "\n" for r in rows))
    return vcf.read_vcf(spark, str(p), **k)


def row(pos, ref, alt, info, *cells, fmt="GT"):
    return ("1", str(pos), f"rs{pos}", ref, alt, ".", "PASS", info, fmt, *cells)


def test_info_names_like_columns(spark, tmp_path):
    d = read(spark, tmp_path, ["s1"], row(1, "A", "C", "ID=x;id=y;A.B=3;AxB=4;GT=5", "0/1"))
    r = d.variants.first()
    assert (r["id"], r["info_ID"], r["info_id_"], r["A_B"], r["info_GT"], r["gt"]) == ("rs1", "x", "y", 3, 5, [0, 1])
    assert d.meta["vcf"]["columns"] == {"info_ID": "ID", "info_id_": "id", "A_B": "A.B", "info_GT": "GT"}
    line = vcf.vcf_lines(d).first()["value"]
    assert line.split("\t")[7] == "ID=x;id=y;A.B=3;GT=5"


def test_codes_of_alleles_that_a_variant_does_not_have(spark, tmp_path):
    for bad in ("0/7", "x/1", "-1/0"):
        with pytest.raises(Exception, match="no allele of this variant"):
            read(spark, tmp_path, ["s1"], row(1, "A", "C", ".", bad)).variants.collect()
        assert read(spark, tmp_path, ["s1"], row(1, "A", "C", ".", bad), strict=False).variants.first()["gt"].count(None) == 1


def test_alleles_counted_by_codes_where_there_is_no_reference(spark, tmp_path):
    d = read(spark, tmp_path, ["s1", "s2"], row(1, ".", ".", ".", "0/2", "./."), row(2, ".", ".", ".", "./.", "./."), row(3, "A", "C,G", ".", "0/1", "0/0"))
    assert [r["num_allele"] for r in d.variants.orderBy("variant_index").collect()] == [3, 1, 3]


def test_all_extra_alleles_are_kept(spark, tmp_path):
    many = "/".join(["0", "1"] * 700)
    d = read(spark, tmp_path, ["s1", "s2", "s3"], row(1, "A", "C", ".", many, "0/1", "1|1"), ploidy=2)
    (x,) = d.variants.first()["geno_extra"]
    assert x["sample_index"] == 1 and len(x["alleles"]) == 1398 and d.variants.first()["gt"] == [0, 1, 0, 1, 1, 1]


def test_tetraploid_file(spark, tmp_path):
    d = read(spark, tmp_path, ["s1", "s2"], row(1, "A", "C", ".", "0/0/1/1", "0/0/0/0"), row(2, "A", "C,G", ".", "0/1/2/.", "./././."))
    assert d.ploidy == 4
    assert {r["sample_index"]: r["missing"] for r in S.missing_per_sample(d).collect()} == {1: 1 / 8, 2: 4 / 8}
    assert [r["counts"] for r in S.all_allele_counts(d).orderBy("variant_index").collect()] == [[6, 2], [1, 1, 1]]
    assert sorted((r["variant_index"], r["sample_index"], r["gt"]) for r in B.geno(d, ["GT"]).collect()) == [(1, 1, "0/0/1/1"), (1, 2, "0/0/0/0"), (2, 1, "0/1/2/."), (2, 2, ".")]
    X.sample_major(d, str(tmp_path / "by"), 2)
    assert spark.read.parquet(str(tmp_path / "by")).count() == 3
    with pytest.raises(ValueError, match="diploid"):
        _ = d.selected_calls


def test_merged_arrays_follow_the_samples(spark, tmp_path):
    a = read(spark, tmp_path, ["s1", "s2"], row(1, "A", "C", ".", "0/1:10", "1/1:20", fmt="GT:GQ"), row(2, "A", "C", ".", "0/0", "0|1"))
    b = read(spark, tmp_path, ["s3", "s4"], row(2, "A", "C", ".", "1/1:7", "./.:8", fmt="GT:GQ"), row(3, "G", "T", ".", "0/1", "0/0"), name="b.vcf")
    m = M.merge(a, b)
    r = {x["position"]: x for x in m.variants.collect()}
    assert [x["sample_id"] for x in m.samples.orderBy("sample_index").collect()] == ["s1", "s2", "s3", "s4"]
    assert r[1]["gt"] == [0, 1, 1, 1, None, None, None, None] and r[1]["fmt_GQ"] == [[10], [20], None, None]
    assert r[2]["gt"] == [0, 0, 0, 1, 1, 1, None, None] and r[2]["fmt_GQ"] == [None, None, [7], [8]] and r[2]["phase"] == [False, True, False, False]
    assert r[3]["gt"] == [None] * 4 + [0, 1, 0, 0] and r[3]["fmt_GQ"] is None
    c = read(spark, tmp_path, ["s2", "s5"], row(9, "A", "C", ".", "1/1:30", "0/1:40", fmt="GT:GQ"), name="c.vcf")
    m = M.merge(a, c)
    r = {x["position"]: x for x in m.variants.collect()}
    assert [x["sample_id"] for x in m.samples.orderBy("sample_index").collect()] == ["s1", "s2", "s5"]
    assert r[1]["gt"] == [0, 1, 1, 1, None, None] and r[1]["fmt_GQ"] == [[10], [20], None]
    assert r[9]["gt"] == [None, None, 1, 1, 0, 1] and r[9]["fmt_GQ"] == [None, [30], [40]]


def test_a_stream_runs_once(spark, tmp_path):
    d = read(spark, tmp_path, ["s1"], row(1, "A", "C", ".", "0/1"), row(2, "A", "C", ".", "0/0"))
    ran = spark.sparkContext.accumulator(0)

    def make(frames):
        for f in frames:
            ran.add(len(f))
            yield f[["variant_index"]].assign(value=f["position"] * 2)

    got = X.add_stream(d, "annotation/info/twice", make, "long")
    assert {r["position"]: r["twice"] for r in got.variants.collect()} == {1: 2, 2: 4} and ran.value == 2


def test_by_sample_functions_get_all_cells(spark, tmp_path):
    import pandas as pd

    d = read(spark, tmp_path, ["s1", "s2"], row(1, "A", "C", ".", "0/1", "0/0"), row(2, "A", "C", ".", "0/0", "0/0"))
    got = U.apply_samples(d, lambda f: pd.DataFrame({"sample_index": [f["sample_index"].iloc[0]], "value": [float(f["a2"].mean())]}))
    assert {r["sample_index"]: r["value"] for r in got.collect()} == {1: 0.5, 2: 0.0}


def test_genotype_texts_are_decoded(spark, tmp_path):
    d = read(spark, tmp_path, ["s1", "s2"], row(1, "A", "C", ".", "0/1", "./0"))
    back = d.coded().with_(variants=d.coded().variants.drop("gt")).decoded()
    assert back.variants.first()["gt"] == [0, 1, None, 0]


def test_bgzf_blocks(spark, tmp_path):
    block = vcf.bgzf_block(b"abc" * 9000)
    assert gzip.decompress(block + vcf.bgzf_block(b"")) == b"abc" * 9000
    assert int.from_bytes(block[16:18], "little") + 1 == len(block) and block[-1] == 0
    assert vcf.bgzf_block(b"") == bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
