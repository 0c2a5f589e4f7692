"""The store: a folder of Parquet tables with a small metadata file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..operators.summary import column_digests
from ..session import ship

FORMAT, VERSION = "variantloom", "1"
#: Presets of compression for Parquet.
PRESETS = {"none": "uncompressed", "fast": "snappy", "lz4": "lz4", "default": "zstd", "zip": "gzip", "max": "zstd", "ultra": "zstd"}
_LEVEL = {"max": 12, "ultra": 19}


def _options(preset: str) -> dict[str, str]:
    if preset not in PRESETS:
        raise ValueError(f"no preset {preset}; there are {', '.join(PRESETS)}")
    return {"compression": PRESETS[preset], **({"parquet.compression.codec.zstd.level": str(_LEVEL[preset])} if preset in _LEVEL else {})}


def save(ds: VariantDataset, path: str, preset: str = "default", by_chromosome: bool = True, digests: bool = False) -> None:
    """Write the selection. Variants are dealt by ranges of chromosome and position, so a long chromosome takes several tasks,
    and sorted, so filters skip folders and row groups. With ``digests``, a hash of every column is kept for ``check``.
    """
    o, p = _options(preset), path.rstrip("/")
    place = ["chromosome", "position", "variant_index"]
    v = ds.variants.repartitionByRange(*place).sortWithinPartitions(*place) if by_chromosome else ds.variants
    w = v.write.mode("overwrite").options(**o)
    (w.partitionBy("chromosome") if by_chromosome else w).parquet(f"{p}/variants")
    ds.samples.write.mode("overwrite").options(**o).parquet(f"{p}/samples")
    if ds.calls is not None:
        ds.selected_calls.repartition(F.floor(F.col("variant_index") / 4096)).sortWithinPartitions("variant_index", "sample_index").write.mode("overwrite").options(**o).parquet(f"{p}/calls")
    hashes = {"digest": {r["name"]: r["md5"] for r in column_digests(ds).collect()}} if digests else {}
    meta = {k: v for k, v in ds.meta.items() if k not in ("variants_filtered", "samples_filtered", "digest")} | hashes | {"file_format": FORMAT, "version": VERSION, "ploidy": ds.ploidy, "has_calls": ds.calls is not None}
    ds.spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{p}/meta")


def open_store(spark: SparkSession, path: str) -> VariantDataset:
    """Open a store; another format or version is an error."""
    ship(spark)
    p = path.rstrip("/")
    meta = json.loads(spark.read.text(f"{p}/meta").first()[0])
    if meta.get("file_format") != FORMAT:
        raise ValueError(f"{path} is no {FORMAT} store")
    if meta.get("version") != VERSION:
        raise ValueError(f"{path} has version {meta.get('version')}")
    # A partition column is read as text: "01" and "1" are different names.
    v = spark.read.option("basePath", f"{p}/variants").parquet(f"{p}/variants").withColumn("chromosome", F.col("chromosome").cast("string"))
    calls = spark.read.parquet(f"{p}/calls") if meta["has_calls"] else None
    return VariantDataset(v, spark.read.parquet(f"{p}/samples"), calls, meta, meta["ploidy"])


def export(ds: VariantDataset, path: str, info: list[str] | None = None, samp: list[str] | None = None, preset: str = "default") -> list[str]:
    """Write the selection with only these fields; returns the names that do not exist."""
    fixed = [c for c in ("variant_index", "variant_id", "chromosome", "position", "allele", "id", "qual", "filter", "gt", "phase", "dp", "ds") if c in ds.variants.columns]
    missing = [n for n in (info or []) if n not in ds.variants.columns] + [n for n in (samp or []) if n not in ds.samples.columns]
    v = ds.variants if info is None else ds.variants.select(*fixed, *[n for n in info if n in ds.variants.columns])
    s = ds.samples if samp is None else ds.samples.select("sample_index", "sample_id", *[n for n in samp if n in ds.samples.columns])
    save(ds.with_(variants=v, samples=s), path, preset)
    return missing


def recompress(spark: SparkSession, path: str, out: str, preset: str) -> None:
    save(open_store(spark, path), out, preset)


def empty(spark: SparkSession, sample_ids: list[str], n_variants: int = 1) -> VariantDataset:
    """A skeleton: zero and blank columns, filter PASS, all calls 0/0."""
    ship(spark)
    i = F.col("id").cast("int") + 1
    v = spark.range(n_variants).select(i.alias("variant_index"), i.cast("long").alias("variant_id"), F.lit("").alias("chromosome"), F.lit(0).alias("position"), F.lit("").alias("allele"), F.lit("").alias("_id"), F.lit(None).cast("double").alias("qual"), F.lit("PASS").alias("filter")).withColumnRenamed("_id", "id")
    s = spark.createDataFrame(list(enumerate(sample_ids, 1)), "sample_index int, sample_id string")
    calls = spark.createDataFrame([], "variant_index int, sample_index int, a1 int, a2 int, phase boolean, dp int, ds double")
    return VariantDataset(v, s, calls, {"file_format": FORMAT, "version": VERSION})


def close(ds: VariantDataset) -> None:
    for t in (ds.variants, ds.samples, ds.calls):
        if isinstance(t, DataFrame):
            t.unpersist()
