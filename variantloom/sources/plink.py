"""PLINK files and dosage tables."""

from __future__ import annotations

import gzip
import lzma
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C
from ..session import ship
from .vcf import numbered_lines

MAGIC = b"\x6c\x1b"
#: Allele pairs of the four 2-bit codes; -1 is missing.
_PAIRS = np.array([[1, 1], [-1, -1], [1, 0], [0, 0]], np.int8)
_CHROMOSOMES = {"23": "X", "24": "Y", "25": "XY", "26": "MT"}


def unpacked(content: bytes) -> bytes:
    """The content of a file that may be gzip or xz."""
    if content[:2] == b"\x1f\x8b":
        return gzip.decompress(content)
    return lzma.decompress(content) if content[:6] == b"\xfd7zXZ\0" else content


def decode_bed(content: bytes, n_samples: int, n_variants: int) -> np.ndarray:
    """Codes, variants x samples, of a BED file of either orientation, plain or compressed."""
    content = unpacked(content)
    if content[:2] != MAGIC:
        raise ValueError("not a BED file")
    by_variant = content[2] == 1
    rows, cols = (n_variants, n_samples) if by_variant else (n_samples, n_variants)
    b = np.frombuffer(content, np.uint8, offset=3).reshape(rows, -(-cols // 4))
    codes = np.stack([(b >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(rows, -1)[:, :cols]
    return codes if by_variant else codes.T


def read_bed(spark: SparkSession, bed: str, bim: str, fam: str, chr_conv: bool = True) -> VariantDataset:
    """Read a binary fileset. The BED content of one file is decoded by one task (a Spark binary cell holds up to 2 GB)."""
    ship(spark)
    fields = lambda n: F.split(F.trim("value"), r"\s+")[n]
    f = numbered_lines(spark, [fam], None).select(F.col("line_ix").cast("int").alias("sample_index"), fields(0).alias("fid"), fields(1).alias("iid"), fields(4).alias("sex"), fields(5).alias("phenotype"))
    twice = f.groupBy("iid").count().where("count > 1").select(F.col("iid").alias("_twice"))
    f = f.join(twice, F.col("iid") == F.col("_twice"), "left")
    samples = f.select("sample_index", F.when(F.col("_twice").isNull(), F.col("iid")).otherwise(F.concat("fid", F.lit("-"), "iid")).alias("sample_id"), F.col("fid").alias("family"), F.when(F.col("sex") == "1", "M").when(F.col("sex") == "2", "F").otherwise("").alias("sex"), "phenotype")
    b = numbered_lines(spark, [bim], None)
    chrom = fields(0)
    if chr_conv:
        for k, name in _CHROMOSOMES.items():
            chrom = F.when(fields(0) == k, name).otherwise(chrom)
    v = b.select(F.col("line_ix").cast("int").alias("variant_index"), F.col("line_ix").alias("variant_id"), chrom.alias("chromosome"), fields(3).cast("int").alias("position"), F.concat(fields(5), F.lit(","), fields(4)).alias("allele"), fields(1).alias("id"), F.lit(100.0).alias("qual"), F.lit("PASS").alias("filter"))
    ns, nv = samples.count(), v.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                codes = decode_bed(content.as_py(), ns, nv)
                for lo in range(0, nv, 1024):
                    g = _PAIRS[codes[lo : lo + 1024]].reshape(-1, 2 * ns)
                    flat = pa.array(g.ravel(), pa.int32(), mask=(g < 0).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(lo + 1, lo + 1 + len(g)), pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(g) + 1) * 2 * ns, pa.int32()), flat)], ["variant_index", "gt"])

    gt = spark.read.format("binaryFile").load(bed).select("content").mapInArrow(run, "variant_index int, gt array<int>")
    phase = F.array_repeat(F.lit(False), ns)
    return VariantDataset(v.join(gt, "variant_index").withColumn("phase", phase), samples, None, {"file_format": "variantloom", "version": "1"})


def bed_rows(ds: VariantDataset) -> DataFrame:
    """(variant_index, row): the BED bytes of each variant; any missing allele makes a call missing."""
    from ..operators.matrix import pack_crumbs

    ploidy = ds.ploidy
    if ploidy != 2:
        raise ValueError("only diploid genotypes have a BED form")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for gt in b.column("gt"):
                g = np.array([-1 if x is None else x for x in gt.as_py()]).reshape(-1, 2)
                alt = (g > 0).sum(1)
                code = np.where((g < 0).any(1), 1, np.array([3, 2, 0])[alt]).astype(np.uint8)
                # The rest of the last byte is zero in a BED file.
                out.append(pack_crumbs(np.concatenate([code, np.zeros(-len(code) % 4, np.uint8)])))
            yield pa.RecordBatch.from_arrays([b.column("variant_index"), pa.array(out, pa.binary())], ["variant_index", "row"])

    return ds.dense().variants.select("variant_index", "gt").mapInArrow(run, "variant_index int, row binary")


def bim_lines(ds: VariantDataset, write_id: str = "annot_id") -> DataFrame:
    a = F.col("allele")
    alt = F.replace(C.alt(a), F.lit(","), F.lit("/"))
    name = F.col("id") if write_id == "annot_id" else F.concat_ws("_", "chromosome", F.col("position").cast("string"), C.ref(a), alt)
    return ds.variants.select("variant_index", F.concat_ws("\t", "chromosome", F.coalesce(F.nullif(name, F.lit("")), F.lit(".")), F.lit("0"), F.col("position").cast("string"), F.coalesce(F.nullif(alt, F.lit("")), F.lit("0")), C.ref(a)).alias("value"))


def fam_lines(ds: VariantDataset) -> DataFrame:
    cols = ds.samples.columns
    sex = F.when(F.col("sex").isin("M", "1"), "1").when(F.col("sex").isin("F", "2"), "2").otherwise("0") if "sex" in cols else F.lit("0")
    pheno = F.coalesce("phenotype", F.lit("-9")) if "phenotype" in cols else F.lit("-9")
    return ds.samples.select("sample_index", F.concat_ws("\t", F.lit("0"), "sample_id", F.lit("0"), F.lit("0"), sex, pheno).alias("value"))


def write_bed(ds: VariantDataset, prefix: str, write_id: str = "annot_id") -> None:
    """Write prefix.bed, .bim and .fam as single files of any Hadoop store; rows stream through the driver in order."""
    jvm = ds.spark._jvm

    def stream(path: str, parts) -> None:
        p = jvm.org.apache.hadoop.fs.Path(path)
        out = p.getFileSystem(ds.spark._jsparkSession.sessionState().newHadoopConf()).create(p, True)
        held = bytearray()
        for x in parts:
            held += x
            if len(held) > 1 << 20:
                out.write(bytes(held))
                held.clear()
        out.write(bytes(held))
        out.close()

    def rows(df: DataFrame, key: str, last: str):
        for r in df.orderBy(key).toLocalIterator(prefetchPartitions=True):
            yield bytes(r[last]) if last == "row" else (r[last] + "\n").encode()

    def bed():
        yield MAGIC + b"\x01"
        yield from rows(bed_rows(ds), "variant_index", "row")

    stream(f"{prefix}.bed", bed())
    stream(f"{prefix}.bim", rows(bim_lines(ds, write_id), "variant_index", "value"))
    stream(f"{prefix}.fam", rows(fam_lines(ds), "sample_index", "value"))


def to_dosages(ds: VariantDataset) -> DataFrame:
    """(variant_index, chromosome, position, allele, dosage): reference counts of each sample, over 3 as 3, alleles as A/B,C."""
    d = F.transform(C.dosage(F.col("gt"), ds.ploidy), lambda x: F.least(F.coalesce(x, F.lit(3)), F.lit(3)))
    return ds.dense().variants.select("variant_index", "chromosome", "position", F.regexp_replace("allele", "^([^,]*),", "$1/").alias("allele"), d.alias("dosage"))


def from_dosages(variants: DataFrame, samples: DataFrame, major_ref: bool = True) -> VariantDataset:
    """A dataset from counts 0 / 1 / 2 of the first allele (others missing) in an array ``dosage``, alleles as A/B.

    With ``major_ref``, a variant whose counts sum to less than its valid samples is turned round.
    """
    ok = F.filter("dosage", lambda x: x.between(0, 2))
    flip = (F.aggregate(ok, F.lit(0), lambda a, x: a + x.cast("int")) < F.size(ok)) if major_ref else F.lit(False)
    a, b = F.substring_index("allele", "/", 1), F.regexp_extract("allele", "^[^/]*/?(.*)$", 1)
    pair = lambda x: F.when(x == 2, F.array(F.lit(0), F.lit(0))).when(x == 1, F.array(F.lit(0), F.lit(1))).when(x == 0, F.array(F.lit(1), F.lit(1))).otherwise(F.array_repeat(F.lit(None).cast("int"), 2))
    v = variants.withColumn("_flip", flip)
    gt = F.flatten(F.transform("dosage", lambda x: F.when(F.col("_flip"), pair(2 - x)).otherwise(pair(x))))
    v = v.withColumns({"gt": gt, "phase": F.array_repeat(F.lit(False), F.size("dosage")), "allele": F.when(F.col("_flip"), F.concat(b, F.lit(","), a)).otherwise(F.concat(a, F.lit(","), b)), "qual": F.lit(100.0), "filter": F.lit("PASS")})
    return VariantDataset(v.drop("dosage", "_flip"), samples, None, {"file_format": "variantloom", "version": "1"})


def real_dosages(dosage: Column, flip: Column) -> Column:
    """Real counts of the first allele as dosages of the other: 2 - x, or x if turned round; outside [0, 2] null."""
    return F.transform(dosage, lambda x: F.when(x.between(0, 2), F.when(flip, x).otherwise(2 - x)))
