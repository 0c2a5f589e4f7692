"""Summaries, checks and digests."""

from __future__ import annotations

import hashlib
import platform
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C


def chromosome_table(ds: VariantDataset) -> DataFrame:
    return ds.variants.groupBy("chromosome").agg(F.count(F.lit(1)).alias("n"))


def allele_number_table(ds: VariantDataset) -> DataFrame:
    return ds.variants.groupBy(C.num_allele(F.col("allele")).alias("num_allele")).agg(F.count(F.lit(1)).alias("n"))


def filter_table(ds: VariantDataset) -> DataFrame:
    return ds.variants.groupBy("filter").agg(F.count(F.lit(1)).alias("n"))


def qual_summary(ds: VariantDataset) -> DataFrame:
    """Least, quartiles (interpolated), mean, most and number of missing qualities."""
    q = F.percentile("qual", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = ds.variants.agg(F.min("qual").alias("min"), q.alias("q"), F.avg("qual").alias("mean"), F.max("qual").alias("max"), F.count_if(F.col("qual").isNull()).alias("missing"))
    return a.select("min", F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"), "mean", F.get("q", F.lit(2)).alias("q3"), "max", "missing")


def phase_summary(ds: VariantDataset) -> DataFrame:
    """Phased calls and all cells."""
    return ds.selected_calls.agg(F.count_if("phase").alias("phased")).withColumn("cells", F.lit(ds.n_samples * ds.n_variants).cast("long"))


def summary(ds: VariantDataset) -> DataFrame:
    """(item, value) of the dimensions and of the id and position columns."""
    v = ds.variants.agg(F.count(F.lit(1)).alias("variants"), F.countDistinct("variant_id").alias("variant_ids"), F.countDistinct("chromosome").alias("chromosomes"), F.min("position").cast("long").alias("position_min"), F.max("position").cast("long").alias("position_max"), F.count_if(F.col("id") == "").alias("blank_ids"))
    s = ds.samples.agg(F.count(F.lit(1)).alias("samples"), F.countDistinct("sample_id").alias("sample_ids"))
    w = v.crossJoin(s).withColumn("ploidy", F.lit(ds.ploidy).cast("long"))
    return w.unpivot([], list(w.columns), "item", "value")


def info_table(frame: DataFrame, default_number: str = "A") -> list[tuple[str, str, str]]:
    """(ID, Number, Type) of data columns, for headers and summaries."""
    return [(f.name, "." if f.dataType.typeName() == "array" else "0" if f.dataType.typeName() == "boolean" else default_number if default_number != "A" else "1", vcf_type(f.dataType.simpleString())) for f in frame.schema.fields]


def vcf_type(spark_type: str) -> str:
    """VCF type of a Spark type (of its elements, for arrays)."""
    t = spark_type
    while t.startswith("array<"):
        t = t[6:-1]
    return {"boolean": "Flag", "tinyint": "Integer", "smallint": "Integer", "int": "Integer", "bigint": "Integer", "binary": "Integer", "float": "Float", "double": "Float"}.get(t, "Float" if t.startswith("decimal") else "String")


def check(ds: VariantDataset) -> DataFrame:
    """(item, ok, detail) of the rules that every dataset keeps."""
    v, s, n = ds.variants, ds.samples, ds.n_samples

    def row(item: str, bad: DataFrame) -> DataFrame:
        return bad.agg(F.count(F.lit(1)).alias("_n")).select(F.lit(item).alias("item"), (F.col("_n") == 0).alias("ok"), F.format_string("%d rows", "_n").alias("detail"))

    rules = [
        row("variant.id is unique", v.groupBy("variant_id").count().where("count > 1 or variant_id is null")),
        row("variant.index is unique", v.groupBy("variant_index").count().where("count > 1 or variant_index is null")),
        row("sample.id is unique", s.groupBy("sample_id").count().where("count > 1 or sample_id is null")),
        row("position is not negative", v.where("position is null or position < 0")),
        row("chromosome is given", v.where("chromosome is null")),
        row("alleles are not empty", v.where(F.col("allele").rlike("^,|,,") | F.col("allele").isNull())),
    ]
    if ds.calls is not None:
        c = ds.calls
        rules.append(row("a call is recorded once", c.groupBy("variant_index", "sample_index").count().where("count > 1")))
        rules.append(row("calls are of known samples", c.join(s, "sample_index", "left_anti") if not ds.meta.get("samples_filtered") else c.limit(0)))
        rules.append(row("allele codes are known", c.join(v.select("variant_index", C.num_allele(F.col("allele")).alias("_n")), "variant_index").where("exists(g, x -> x >= _n or x < 0)" if "g" in c.columns else "a1 >= _n or a2 >= _n or a1 < 0 or a2 < 0")))
    for name, width in (("gt", ds.ploidy), ("phase", 1), ("dp", 1), ("ds", 1)):
        if name in v.columns:
            rules.append(row(f"{name} has a value for each sample", v.where(F.size(name) != n * width)))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def digest(rows: DataFrame, value: Column, index: str = "variant_index") -> DataFrame:
    """(md5, n) of a column, the same however the rows are dealt.

    Every value is hashed with its index; the hashes are added up modulo 2^128 and the sum is hashed, so no order
    and no single task is needed. Equal columns have equal digests; a changed, moved or missing value changes it.
    """
    h = F.md5(F.concat(F.col(index).cast("string"), F.lit("\x00"), F.when(value.isNull(), "n").otherwise("v"), F.coalesce(value.cast("string"), F.lit(""))))
    part = lambda i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(*[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).alias("n"))
    return sums.select(F.md5(F.concat_ws(":", *[F.col(f"s{i}").cast("string") for i in range(4)], F.col("n").cast("string"))).alias("md5"), "n")


def column_digests(ds: VariantDataset) -> DataFrame:
    """(name, md5) of every column of variants and samples and of the calls, one aggregation a table."""

    def table(rows: DataFrame, folder: str, index: str) -> DataFrame:
        names = [c for c in rows.columns if c != index]
        sums = []
        for n, c in enumerate(names):
            text = F.to_json(F.struct(F.col(f"`{c}`").alias("x")))
            h = F.md5(F.concat(F.col(index).cast("string"), F.lit("\x00"), text))
            sums += [F.coalesce(F.sum(F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)")), F.lit(0)).alias(f"s{n}_{i}") for i in range(4)]
        one = rows.agg(*sums, F.count(F.lit(1)).alias("n"))
        each = [F.struct(F.lit(f"{folder}/{c}").alias("name"), F.md5(F.concat_ws(":", *[F.col(f"s{n}_{i}").cast("string") for i in range(4)], F.col("n").cast("string"))).alias("md5")) for n, c in enumerate(names)]
        return one.select(F.explode(F.array(*each)).alias("x")).select("x.*")

    out = table(ds.variants, "variants", "variant_index").unionByName(table(ds.samples, "samples", "sample_index"))
    if ds.calls is not None:
        c = ds.selected_calls
        cell = c.select(F.concat_ws(":", "variant_index", "sample_index").alias("_at"), F.struct(*(["g"] if "g" in c.columns else ["a1", "a2"]), "phase", "dp", "ds").alias("call"))
        out = out.unionByName(table(cell, "calls", "_at"))
    return out


def check_digests(ds: VariantDataset) -> DataFrame:
    """(name, ok): whether each column still has the hash that was kept when the data were written; null without a kept one."""
    kept = ds.meta.get("digest") or {}
    rows = column_digests(ds)
    if not kept:
        return rows.select("name", F.lit(None).cast("boolean").alias("ok"))
    known = ds.spark.createDataFrame(sorted(kept.items()), "name string, _kept string")
    return rows.join(known, "name", "full_outer").select("name", F.when(F.col("_kept").isNotNull(), F.coalesce(F.col("md5") == F.col("_kept"), F.lit(False))).alias("ok"))


def field_tables(ds: VariantDataset) -> DataFrame:
    """(kind, id, number, type, description) of all that the dataset says of itself: INFO and FORMAT fields (of columns, with
    what the file's header says of them), FILTER, ALT, contigs, references, sample annotation and kept digests."""
    h = ds.meta.get("vcf", {})
    name = lambda c: h.get("columns", {}).get(c, c.removeprefix("fmt_"))
    fixed = {"variant_index", "variant_id", "chromosome", "position", "allele", "id", "qual", "filter", "gt", "gs", "phase", "geno_extra", "num_allele"}
    rows = []
    for f in ds.variants.schema.fields:
        kind = f.dataType.simpleString()
        if f.name in fixed:
            continue
        fmt = f.name.startswith("fmt_") or f.name in ("dp", "ds") and kind.startswith("array")
        e = h.get("format" if fmt else "info", {}).get(name(f.name), {})
        number = "." if kind.startswith("array<array") or kind.startswith("array") and not fmt else "0" if kind == "boolean" else "1"
        rows.append(("format" if fmt else "info", name(f.name).upper() if f.name in ("dp", "ds") else name(f.name), e.get("Number", number), e.get("Type", vcf_type(kind)), e.get("Description", "")))
    if ds.calls is not None:
        rows += [("format", "DP", "1", "Integer", ""), ("format", "DS", "1", "Float", "")]
    for kind in ("filter", "alt", "contig"):
        rows += [(kind, k, "", "", e.get("Description", e.get("length", ""))) for k, e in h.get(kind, {}).items()]
    rows += [("reference", r, "", "", "") for r in h.get("reference", [])]
    rows += [("sample", f.name, "1", vcf_type(f.dataType.simpleString()), "") for f in ds.samples.schema.fields if f.name not in ("sample_index", "sample_id")]
    rows += [("digest", k, "", "md5", v) for k, v in sorted((ds.meta.get("digest") or {}).items())]
    return ds.spark.createDataFrame(rows, "kind string, id string, number string, type string, description string")


def ordered_digest(rows: DataFrame, value: Column, index: str = "variant_index", algorithm: str = "md5") -> DataFrame:
    """The digest over the values' bytes in index order (text ends with a zero byte): order-bound, so one stream over sorted rows.

    For parity on small selections; digest() is the scalable one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = hashlib.new(algorithm), 0
        for b in batches:
            col = b.column("v")
            if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
                for x in col.to_pylist():
                    h.update((x or "").encode() + b"\0")
            else:
                kind = {"int32": "<i4", "int64": "<i8", "double": "<f8", "float": "<f4", "bool": "u1"}[str(col.type)]
                h.update(col.to_numpy(zero_copy_only=False).astype(kind).tobytes())
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([h.hexdigest()]), pa.array([n], pa.int64())], ["digest", "n"])

    one = rows.select(F.col(index).alias("i"), value.alias("v")).repartition(1).sortWithinPartitions("i").select("v")
    return one.mapInArrow(run, "digest string, n long")


def system(spark: SparkSession) -> dict[str, str]:
    """Versions, parallelism and options of the running session."""
    c = spark.sparkContext
    return {"spark": spark.version, "python": platform.python_version(), "master": c.master, "default_parallelism": str(c.defaultParallelism), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "adaptive": spark.conf.get("spark.sql.adaptive.enabled", "true")}
