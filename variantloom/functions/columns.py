"""Derived columns of variants: dosages, alleles, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def alleles(allele: Column) -> Column:
    """The alleles as an array; '' has none. A leading or doubled comma is an error."""
    bad = F.raise_error(F.concat(F.lit("empty allele in "), allele)).cast("array<string>")
    return F.when(allele == "", F.array().cast("array<string>")).when(allele.rlike("^,|,,"), bad).otherwise(F.split(allele, ",", -1))


def num_allele(allele: Column) -> Column:
    return F.size(alleles(allele))


def ref(allele: Column) -> Column:
    return F.substring_index(allele, ",", 1)


def alt(allele: Column) -> Column:
    """All after the first comma, '' without one."""
    return F.regexp_extract(allele, r"^[^,]*,?(.*)$", 1)


def allele_index(allele: Column, wanted: Column) -> Column:
    """0-based index of an allele, null if it is absent or null."""
    return F.nullif(F.array_position(alleles(allele), wanted), F.lit(0)).cast("int") - 1


def chrom_pos(chromosome: Column, position: Column) -> Column:
    return F.concat(chromosome, F.lit(":"), position.cast("string"))


def chrom_pos_allele(chromosome: Column, position: Column, allele: Column) -> Column:
    return F.concat(chromosome, F.lit(":"), position.cast("string"), F.lit("_"), F.replace(allele, F.lit(","), F.lit("_")))


def end_position(position: Column, allele: Column) -> Column:
    return position + F.greatest(F.length(ref(allele)), F.lit(1)) - 1


def genotype_layers(n_allele: Column) -> Column:
    """2-bit layers that a variant's codes need: the least k >= 1 with n_allele + 1 <= 4^k."""
    c = F.lit(16)
    for k in range(15, 0, -1):
        c = F.when(n_allele + 1 <= 4**k, k).otherwise(c)
    return c


def per_sample(gt: Column, ploidy: int, f) -> Column:
    """f(alleles of one sample) over the samples of a flattened genotype."""
    n = (F.size(gt) / ploidy).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: f(F.slice(gt, i * ploidy + 1, ploidy)))).otherwise(F.array().cast("array<int>"))


def dosage(gt: Column, ploidy: int = 2) -> Column:
    """Reference alleles of each sample; null if any allele is missing."""
    return per_sample(gt, ploidy, lambda g: F.when(~F.exists(g, lambda x: x.isNull()), F.size(F.filter(g, lambda x: x == 0))))


def dosage_alt(gt: Column, ploidy: int = 2) -> Column:
    """Other alleles of each sample; null if any allele is missing."""
    return per_sample(gt, ploidy, lambda g: F.when(~F.exists(g, lambda x: x.isNull()), F.size(F.filter(g, lambda x: x != 0))))


def dosage_alt2(gt: Column, ploidy: int = 2) -> Column:
    """Other alleles of each sample; null only if all alleles are missing."""
    return per_sample(gt, ploidy, lambda g: F.when(F.exists(g, lambda x: x.isNotNull()), F.size(F.filter(g, lambda x: x != 0))))


def call_dosage(a1: Column, a2: Column) -> Column:
    """Reference alleles of one diploid call (sparse form)."""
    return F.when(a1.isNotNull() & a2.isNotNull(), (a1 == 0).cast("int") + (a2 == 0).cast("int"))


def call_dosage_alt(a1: Column, a2: Column) -> Column:
    return F.when(a1.isNotNull() & a2.isNotNull(), (a1 != 0).cast("int") + (a2 != 0).cast("int"))


def call_dosage_alt2(a1: Column, a2: Column) -> Column:
    return F.when(a1.isNotNull() | a2.isNotNull(), F.coalesce((a1 != 0).cast("int"), F.lit(0)) + F.coalesce((a2 != 0).cast("int"), F.lit(0)))


def cell_dosage(g: Column) -> Column:
    """Reference alleles of one cell of any ploidy; null if any allele is missing."""
    return F.when(~F.exists(g, lambda x: x.isNull()), F.size(F.filter(g, lambda x: x == 0)))


def cell_dosage_alt(g: Column) -> Column:
    return F.when(~F.exists(g, lambda x: x.isNull()), F.size(F.filter(g, lambda x: x != 0)))


def cell_dosage_alt2(g: Column) -> Column:
    return F.when(F.exists(g, lambda x: x.isNotNull()), F.size(F.filter(g, lambda x: x != 0)))


def gt_text(gt: Column, phase: Column, ploidy: int = 2) -> Column:
    """VCF text of each sample's genotype: codes or '.', joined by '|' if phased, else '/'."""
    n = (F.size(gt) / ploidy).cast("int")
    one = lambda i: F.array_join(F.transform(F.slice(gt, i * ploidy + 1, ploidy), lambda x: F.coalesce(x.cast("string"), F.lit("."))), "#")
    mark = lambda i: F.when(F.coalesce(F.get(phase, i), F.lit(False)), "|").otherwise("/")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.replace(one(i), F.lit("#"), mark(i)))).otherwise(F.array().cast("array<string>"))


def sparse_entries(calls: DataFrame, value: Column) -> DataFrame:
    """(sample_index, variant_index, value) of the entries that are not 0; a missing value is an entry with null."""
    return calls.select("sample_index", "variant_index", value.alias("value")).where("value is null or value <> 0")


def chromosome_runs(variants: DataFrame) -> DataFrame:
    """(run, chromosome, length) of the chromosome over the selected variants in order.

    A chromosome's rows form runs where the rank among the selected rows less the rank among
    the chromosome's own rows stays the same; the global rank is only needed where
    chromosomes alternate, so it comes from per-chromosome extents if these are disjoint.
    """
    ext = variants.groupBy("chromosome").agg(F.min("variant_index").alias("lo"), F.max("variant_index").alias("hi"), F.count(F.lit(1)).alias("length"))
    over = ext.withColumn("_prev", F.max("hi").over(Window.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1))).where("_prev > lo")
    if over.isEmpty():
        return ext.select(F.row_number().over(Window.orderBy("lo")).cast("int").alias("run"), "chromosome", F.col("length").cast("long").alias("length"))
    from ..operators.filters import numbered

    g = numbered(variants.select("variant_index", "chromosome"), "variant_index").withColumnRenamed("_rank", "_all")
    g = numbered(g, "variant_index", "chromosome").withColumn("_own", F.min("_rank").over(Window.partitionBy("chromosome")))
    runs = g.groupBy("chromosome", (F.col("_all") - F.col("_rank") + F.col("_own")).alias("_g")).agg(F.min("variant_index").alias("lo"), F.count(F.lit(1)).alias("length"))
    return runs.select(F.row_number().over(Window.orderBy("lo")).cast("int").alias("run"), "chromosome", "length")


def chrom_pos2(variants: DataFrame) -> DataFrame:
    """Add chrom_pos2: chr:pos, with _1, _2, ... on rows that repeat the position of the row before.

    Windows are per chromosome; repeats cannot cross one. Where a chromosome's rows are not next to each
    other, a different row between two equal positions ends the run as well.
    """
    w = Window.partitionBy("chromosome").orderBy("variant_index")
    new = ~F.col("position").eqNullSafe(F.lag("position").over(w))
    v = variants.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    n = F.row_number().over(Window.partitionBy("chromosome", "_run").orderBy("variant_index")) - 1
    text = F.when(n > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise("")
    return v.withColumn("chrom_pos2", F.concat(chrom_pos(F.col("chromosome"), F.col("position")), text)).drop("_run")


def derived(variants: DataFrame) -> DataFrame:
    """variants with the derived scalar columns."""
    a, c, p = F.col("allele"), F.col("chromosome"), F.col("position")
    return chrom_pos2(variants).select("variant_index", num_allele(a).alias("num_allele"), ref(a).alias("ref"), alt(a).alias("alt"), chrom_pos(c, p).alias("chrom_pos"), "chrom_pos2", chrom_pos_allele(c, p, a).alias("chrom_pos_allele"), end_position(p, a).alias("end_position"), genotype_layers(num_allele(a)).alias("layers"))
