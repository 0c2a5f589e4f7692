"""Accessor tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C


def granges(ds: VariantDataset) -> DataFrame:
    p = F.col("position")
    return ds.variants.select("variant_id", "chromosome", p.alias("start"), C.end_position(p, F.col("allele")).alias("end"))


def iupac(text: Column) -> Column:
    """Characters that are no nucleotide codes as '.'."""
    return F.regexp_replace(text, r"[^ACGTMRWSYKVHDBNacgtmrwsykvhdbn+.-]", ".")


def ref_alt(ds: VariantDataset) -> DataFrame:
    """(variant_id, ref, alt): alt as an array, empty without other alleles."""
    a = C.alt(F.col("allele"))
    return ds.variants.select("variant_id", iupac(C.ref(F.col("allele"))).alias("ref"), F.when(a == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(a, ","), iupac)).alias("alt"))


def fixed(ds: VariantDataset) -> DataFrame:
    return ref_alt(ds).join(ds.variants.select("variant_id", F.when(~F.isnan("qual"), F.col("qual")).alias("qual"), "filter"), "variant_id")


def row_ranges(ds: VariantDataset) -> DataFrame:
    return granges(ds).join(fixed(ds), "variant_id")


def col_data(ds: VariantDataset) -> DataFrame:
    """The sample table, with the samples numbered from 1."""
    from .filters import numbered

    s = numbered(ds.samples, "sample_index").withColumnRenamed("_rank", "samples")
    return s.select("samples", *[c for c in ds.samples.columns if c != "sample_index"])


def info(ds: VariantDataset, name: str, number: str = "1") -> DataFrame:
    """(variant_id, value): '' is null; with number A, an array filled up with nulls to one value an alternative allele."""
    x = F.col(name)
    kind = ds.variants.schema[name].dataType
    if kind.typeName() == "string":
        x = F.nullif(x, F.lit(""))
    if number == "A":
        x = x if kind.typeName() == "array" else F.array(x)
        n = F.greatest(C.num_allele(F.col("allele")) - 1, F.lit(0))
        x = F.concat(F.slice(x, F.lit(1), F.least(F.size(x), n)), F.array_repeat(F.lit(None), F.greatest(n - F.size(x), F.lit(0))))
    return ds.variants.select("variant_id", x.alias("value"))


def cell_text(g: Column, phase: Column) -> Column:
    """Genotype text of a cell of any ploidy, '.' if all alleles are missing."""
    codes = F.transform(g, lambda x: F.coalesce(x.cast("string"), F.lit(".")))
    return F.when(F.forall(g, lambda x: x.isNull()), ".").otherwise(F.replace(F.array_join(codes, "/"), F.lit("/"), F.when(phase, F.lit("|")).otherwise(F.lit("/"))))


def geno(ds: VariantDataset, fields: list[str] | None = None, recorded: bool = False) -> DataFrame:
    """(variant_index, sample_index, gt, ...) of all cells, with other FORMAT fields by name; ``recorded``: of the recorded calls only.

    ``fields`` names what to take (GT, DP, DS, or a field that was read from a file); all by default. A field that a
    variant does not have is null.
    """
    if recorded:
        return ds.selected_cells.select("variant_index", "sample_index", cell_text(F.col("g"), F.col("phase")).alias("gt"))
    if ds.calls is not None and fields is not None and set(fields) <= {"GT", "DP", "DS"} and not {"gt", "gs"} & set(ds.variants.columns):
        return _geno_of_calls(ds, fields)
    d = ds.dense()
    have = {"DP": "dp", "DS": "ds"} | {c.removeprefix("fmt_"): c for c in d.variants.columns if c.startswith("fmt_")}
    kind = {f.name: f.dataType.typeName() for f in d.variants.schema.fields}
    have = {n: c for n, c in have.items() if kind.get(c) == "array"}
    names = ["GT", *sorted(have)] if fields is None else fields
    if missing := [n for n in names if n != "GT" and n not in have]:
        raise KeyError(f"no such field: {', '.join(missing)}")
    p = ds.ploidy
    text = lambda i: cell_text(F.slice("gt", i * p + 1, p), F.coalesce(F.get(F.col("phase"), i), F.lit(False)))
    one = lambda i: F.struct((i + 1).alias("_s"), *[(text(i) if n == "GT" else F.get(F.col(have[n]), i)).alias(n.lower()) for n in names])
    cells = d.variants.where(F.lit(ds.n_samples > 0)).select("variant_index", F.explode(F.transform(F.sequence(F.lit(0), F.lit(max(ds.n_samples, 1) - 1)), one)).alias("x")).select("variant_index", "x.*")
    return cells.join(d._places(), "_s").select("variant_index", "sample_index", *[n.lower() for n in names])


def _geno_of_calls(ds: VariantDataset, fields: list[str]) -> DataFrame:
    """The cells as the recorded calls and, between those of a variant, runs of samples with the plain cell.

    The rows are variants x samples by nature; a task holds the places of one variant's calls and one run at a time.
    """
    p, n = ds.ploidy, ds.n_samples
    names = [f.lower() for f in fields]
    own = {"gt": cell_text(F.col("g"), F.col("phase")), "dp": F.col("dp"), "ds": F.col("ds")}
    kind = dict(ds.calls.dtypes)
    plain = {"gt": F.lit("/".join("0" * p)), "dp": F.lit(None).cast("int"), "ds": F.lit(0.0)}
    if kind["ds"].startswith("array"):
        plain["ds"] = F.array_repeat(F.lit(0.0), F.greatest(C.num_allele(F.col("allele")) - 1, F.lit(1)))
    told = ds.selected_cells.select("variant_index", "sample_index", *[own[c].alias(c) for c in names])
    # Runs (lo, hi) before each record and after the last; the places are those of the selected samples in order.
    e = F.coalesce(F.col("e"), F.array().cast("array<struct<_s:int,v:int>>"))
    edges = lambda first, last: F.concat(F.array(F.lit(0)) if first else F.array().cast("array<int>"), F.transform(e, lambda x: x["_s"]), F.array(F.lit(n + 1)) if last else F.array().cast("array<int>"))
    runs = F.filter(F.zip_with(edges(True, False), edges(False, True), lambda a, b: F.struct((a + 1).alias("lo"), (b - 1).alias("hi"))), lambda x: x["lo"] <= x["hi"])
    v = ds._recorded(F.lit(0)).select("variant_index", *[plain[c].alias(c) for c in names], F.explode(runs).alias("x"))
    rest = v.select("variant_index", F.explode(F.sequence("x.lo", "x.hi")).alias("_s"), *names)
    if ds.meta.get("samples_filtered"):
        rest = rest.join(ds._places(), "_s")
    else:
        rest = rest.withColumnRenamed("_s", "sample_index")
    return told.unionByName(rest.select("variant_index", "sample_index", *names))


def genotype_table(ds: VariantDataset) -> DataFrame:
    """(gt, n) of unphased genotype texts over all cells, counted from the calls."""
    per = ds.selected_cells.select(F.when(~F.exists("g", lambda x: x.isNull()), F.array_join(F.col("g").cast("array<string>"), "/")).alias("gt")).groupBy("gt").agg(F.count(F.lit(1)).alias("n"))
    total = ds.n_samples * ds.n_variants
    rest = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("k")).select(F.lit("/".join(["0"] * ds.ploidy)).alias("gt"), (F.lit(total) - F.col("k")).alias("n"))
    return per.unionByName(rest).groupBy("gt").agg(F.sum("n").alias("n")).where("n > 0")


def as_vcf(ds: VariantDataset) -> DataFrame:
    """One row per variant with its fixed columns and its genotype texts in sample order."""
    d = ds.dense()
    return d.variants.select("variant_id", "chromosome", "position", "id", C.ref(F.col("allele")).alias("ref"), C.alt(F.col("allele")).alias("alt"), "qual", "filter", C.gt_text(F.col("gt"), F.col("phase"), ds.ploidy).alias("gt"))
