"""Packed genotypes and matrix recipes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C


def pack_crumbs(codes: np.ndarray, ext: int = 0) -> bytes:
    """2-bit codes, four a byte from the low bits up; the rest of the last byte is ones, and ``ext`` bytes 0xFF follow."""
    n = -(-len(codes) // 4) * 4
    full = np.full(n, 3, np.uint8)
    full[: len(codes)] = codes
    q = full.reshape(-1, 4)
    return (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).astype(np.uint8).tobytes() + b"\xff" * ext


def _packed(ploidy: int, ext: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for gt in b.column("gt"):
                g = np.array([-1 if x is None else x for x in gt.as_py()]).reshape(-1, ploidy)
                alt = (g > 0).sum(1)
                out.append(pack_crumbs(np.where((g < 0).all(1) | (alt > 2), 3, alt).astype(np.uint8), ext))
            yield pa.RecordBatch.from_arrays([b.column("variant_index"), pa.array(out, pa.binary())], ["variant_index", "packed"])

    return run


def pack_by_variant(ds: VariantDataset, ext: int = 0) -> DataFrame:
    """(variant_index, packed): four samples a byte, 0 / 1 / 2 other alleles (missing only if all are), else 3."""
    return ds.dense().variants.select("variant_index", "gt").mapInArrow(_packed(ds.ploidy, ext), "variant_index int, packed binary")


def pack_by_variant_native(ds: VariantDataset) -> DataFrame:
    """The same bytes from JVM expressions alone, as hexadecimal text."""
    alt = C.dosage_alt2(F.col("gt"), ds.ploidy)
    code = F.transform(alt, lambda x: F.when(x.isNull() | (x > 2), 3).otherwise(x))
    n = F.size("c")
    four = lambda i: sum(F.coalesce(F.get(F.col("c"), i * 4 + k), F.lit(3)) * 4**k for k in range(4))
    byte = F.transform(F.sequence(F.lit(0), ((n - 1) / 4).cast("int")), lambda i: F.lpad(F.lower(F.hex(four(i))), 2, "0"))
    return ds.dense().variants.select("variant_index", code.alias("c")).select("variant_index", F.array_join(byte, "").alias("packed_hex"))


def pack_by_sample(ds: VariantDataset) -> DataFrame:
    """(sample_index, block, packed): blocks of four variants in file order, one byte each as an int; any ploidy.

    The code arrays of four variants meet in one row, which is taken apart by sample there; unused bits are ones.
    """
    d, p = ds.dense(), ds.ploidy
    code = F.transform(C.dosage_alt2(F.col("gt"), p), lambda x: F.least(F.coalesce(x, F.lit(3)), F.lit(3)))
    v = d.variants.select(F.floor((F.col("variant_index") - 1) / 4).alias("block"), ((F.col("variant_index") - 1) % 4).alias("k"), code.alias("c"))
    four = v.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("m"))
    byte = lambda i: sum(F.coalesce(F.get(F.try_element_at("m", F.lit(k)), i), F.lit(3)) * 4**k for k in range(4))
    rows = four.where(F.lit(ds.n_samples > 0)).select("block", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(max(ds.n_samples, 1) - 1)), byte)).alias("_p", "packed"))
    return rows.withColumn("_s", F.col("_p") + 1).join(d._places(), "_s").select("sample_index", "block", F.col("packed").cast("int").alias("packed"))


def gram(ds: VariantDataset, block: int = 512) -> np.ndarray:
    """Sample covariance of standardised reference dosages, sum (g - 2p)(g' - 2p) / (p (1 - p)), scaled to a trace of n.

    Every batch of variants gives one partial n x n product with numpy; partials are added up by row in Spark, so only the
    final matrix, samples x samples, comes to the driver.
    """
    n, p = ds.n_samples, ds.ploidy

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((n, n))
        for b in batches:
            for lo in range(0, b.num_rows, block):
                rows = b.column("gt").slice(lo, block).to_pylist()
                g = np.array([[np.nan if x is None else x for x in r] for r in rows]).reshape(len(rows), n, p)
                d = np.where(np.isnan(g).any(2), np.nan, (g == 0).sum(2))
                with np.errstate(invalid="ignore", divide="ignore"):
                    mean = np.nanmean(d, axis=1) if len(d) else np.zeros(0)
                    f = mean / p
                    w = 1 / (f * (1 - f))
                    z = np.where(np.isnan(d), 0, d - mean[:, None])
                ok = np.isfinite(w)
                total += (z[ok] * w[ok, None]).T @ z[ok]
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array(list(total))], ["row", "part"])

    parts = ds.dense().variants.select("gt").mapInArrow(run, "row int, part array<double>")
    cells = parts.select("row", F.posexplode("part").alias("col", "v")).groupBy("row", "col").agg(F.sum("v").alias("v"))
    out = np.zeros((n, n))
    for r in cells.toLocalIterator():
        out[r["row"], r["col"]] = r["v"]
    t = np.trace(out)
    return out * (n / t) if t else out


def principal_components(ds: VariantDataset, k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors) of the leading k components."""
    values, vectors = np.linalg.eigh(gram(ds))
    order = np.argsort(values)[::-1][:k]
    return values[order], vectors[:, order]


def inbreeding(ds: VariantDataset) -> DataFrame:
    """(sample_index, f): mean over variants of (g^2 - g (1 + 2p) + 2 p^2) / (2 p (1 - p)), g reference dosages, p their frequency.

    Aggregated from recorded calls: what a 0/0 cell adds depends on the variant alone, so absent cells are the total over
    all variants less that of the recorded ones.
    """
    from . import stats as S

    n = S.counts(ds).select("variant_index", S.frequency().alias("p")).where("p > 0 and p < 1")
    term = lambda g: (g * g - g * (1 + 2 * F.col("p")) + 2 * F.col("p") * F.col("p")) / (2 * F.col("p") * (1 - F.col("p")))
    two = F.lit(float(ds.ploidy))
    all_ = n.agg(F.sum(term(two)).alias("_t"), F.count(F.lit(1)).alias("_n"))
    g = C.cell_dosage(F.col("g")).cast("double")
    per = ds.selected_cells.join(n, "variant_index").groupBy("sample_index").agg(F.sum(term(two)).alias("_less"), F.sum(term(g)).alias("_add"), F.sum(g.isNull().cast("int")).alias("_miss"))
    s = ds.samples.select("sample_index").join(per, "sample_index", "left").crossJoin(F.broadcast(all_))
    total = F.coalesce("_t", F.lit(0.0)) - F.coalesce("_less", F.lit(0.0)) + F.coalesce("_add", F.lit(0.0))
    return s.select("sample_index", F.try_divide(total, (F.col("_n") - F.coalesce("_miss", F.lit(0))).cast("double")).alias("f"))


def rounded_dosage(x: Column) -> Column:
    """A real dosage as a code: half away from zero, else 3."""
    r = F.round(x, 0).cast("int")
    return F.when(r.between(0, 2), r).otherwise(3)
