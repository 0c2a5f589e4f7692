"""Allele frequencies, allele counts and missing rates (A1-A13), over sparse calls, dense genotypes or dosages.

Undefined values are null, never NaN. Counts stay integers until the one division.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C


def _alleles(ds: VariantDataset) -> list[Column]:
    """The codes of a cell one by one."""
    return [F.get("g", F.lit(i)) for i in range(ds.ploidy)]


def _n_missing(ds: VariantDataset) -> Column:
    return sum(a.isNull().cast("long") for a in _alleles(ds))


def call_counts(ds: VariantDataset, index: Column | None = None) -> DataFrame:
    """variants plus n_total, n_missing and n_allele (alleles with code ``index``, an expression over variants; 0 by default).

    Only recorded calls are aggregated; all other cells are 0/0 by definition.
    """
    v = ds.variants.withColumn("_k", (F.lit(0) if index is None else index).cast("int"))
    c = ds.selected_cells
    if index is not None:
        c = c.join(v.select("variant_index", "_k"), "variant_index")
        k = F.col("_k")
    else:
        k = F.lit(0)
    # A call of k and an allele: null compares to null and is not counted.
    hit = sum(F.when(a == k, 1).otherwise(0) for a in _alleles(ds))
    agg = c.groupBy("variant_index").agg(
        F.count(F.lit(1)).alias("_rec"),
        F.sum(_n_missing(ds)).alias("_nm"),
        F.sum(hit.cast("long")).alias("_nk"),
    )
    n = ds.ploidy * ds.n_samples
    out = v.join(agg, "variant_index", "left")
    rest = F.when(F.col("_k") == 0, n - ds.ploidy * F.coalesce("_rec", F.lit(0))).otherwise(0)
    out = out.withColumn("n_total", F.lit(n).cast("long")).withColumn("n_missing", F.coalesce("_nm", F.lit(0)))
    return out.withColumn("n_allele", F.when(F.col("_k").isNotNull(), (F.coalesce("_nk", F.lit(0)) + rest).cast("long"))).drop("_k", "_rec", "_nm", "_nk")


def dense_counts(ds: VariantDataset, index: Column | None = None) -> DataFrame:
    """The same counts from the ``gt`` arrays; a narrow projection without a shuffle.

    Arrays that are laid out from calls are not: they have samples x variants cells, so the calls are counted instead.
    """
    if ds.calls is not None:
        return call_counts(ds, index)
    k = F.lit(0) if index is None else index
    v = ds.variants.withColumn("_k", k.cast("int"))
    v = v.withColumn("n_total", F.size("gt").cast("long")).withColumn("n_missing", F.size(F.filter("gt", lambda x: x.isNull())).cast("long"))
    return v.withColumn("n_allele", F.when(F.col("_k").isNotNull(), F.size(F.filter("gt", lambda x: x == F.col("_k"))).cast("long"))).drop("_k")


def coded_counts(ds: VariantDataset, index: Column | None = None) -> DataFrame:
    """The same counts from the genotype texts: bytes that are left when a code is taken out; of calls as in dense_counts."""
    if ds.calls is not None:
        return call_counts(ds, index)
    from ..dataset import allele_code

    k = (F.lit(0) if index is None else index).cast("int")
    without = lambda code, text="gs": F.octet_length("gs") - F.octet_length(F.replace(text, code, F.lit("")))
    # Most codes are 0: runs of eight are taken out first, which leaves few single steps.
    zeros = without(F.lit("0"), F.replace(F.col("gs"), F.lit("0" * 8), F.lit("")))
    v = ds.variants.withColumn("n_total", F.octet_length("gs").cast("long")).withColumn("n_missing", without(F.lit(".")).cast("long"))
    return v.withColumn("n_allele", F.when(k.isNotNull(), zeros if index is None else without(allele_code(k))).cast("long"))


def counts(ds: VariantDataset, index: Column | None = None) -> DataFrame:
    """Counts from the form that the dataset has: calls, else texts, else arrays."""
    form = call_counts if ds.calls is not None else coded_counts if "gs" in ds.variants.columns else dense_counts
    return form(ds, index)


def frequency(minor: bool = False) -> Column:
    """n_allele over the alleles that are not missing; folded to the minor side if asked for."""
    af = F.try_divide(F.col("n_allele").cast("double"), (F.col("n_total") - F.col("n_missing")).cast("double"))
    return F.when(af > 0.5, 1 - af).otherwise(af) if minor else af


def count(minor: bool = False) -> Column:
    """n_allele, null where all alleles are missing."""
    n = F.col("n_total") - F.col("n_missing")
    c = F.least(F.col("n_allele"), n - F.col("n_allele")) if minor else F.col("n_allele")
    return F.when(n > 0, c)


def missing_rate() -> Column:
    return F.try_divide(F.col("n_missing").cast("double"), F.col("n_total").cast("double"))


def reference_index(ref_allele, allele: Column | None = None) -> Column | None:
    """The allele code that ``ref_allele`` names: an int, a column of ints, or (as text) a column of allele strings.

    A code at or over the number of alleles, a null and an unknown string give null.
    """
    a = F.col("allele") if allele is None else allele
    if isinstance(ref_allele, int):
        return None if ref_allele == 0 else F.when(F.lit(ref_allele) < C.num_allele(a), F.lit(ref_allele))
    return F.when(ref_allele < C.num_allele(a), ref_allele)


def allele_freq(ds: VariantDataset, ref_allele: int | Column = 0, minor: bool = False, dense: bool = False) -> DataFrame:
    """(variant_index, af)."""
    n = (dense_counts if dense else counts)(ds, reference_index(ref_allele))
    return n.select("variant_index", frequency(minor).alias("af"))


def allele_freq_of(ds: VariantDataset, wanted: Column, minor: bool = False) -> DataFrame:
    """(variant_index, af) of the allele that a string column over variants names."""
    return counts(ds, C.allele_index(F.col("allele"), wanted)).select("variant_index", frequency(minor).alias("af"))


def allele_count(ds: VariantDataset, ref_allele: int | Column = 0, minor: bool = False, dense: bool = False) -> DataFrame:
    """(variant_index, ac)."""
    n = (dense_counts if dense else counts)(ds, reference_index(ref_allele))
    return n.select("variant_index", count(minor).alias("ac"))


def allele_count_of(ds: VariantDataset, wanted: Column, minor: bool = False) -> DataFrame:
    return counts(ds, C.allele_index(F.col("allele"), wanted)).select("variant_index", count(minor).alias("ac"))


def all_allele_counts(ds: VariantDataset) -> DataFrame:
    """(variant_index, n, counts): alleles that are not missing, and the count of each known allele, in order.

    Codes beyond the known alleles count in n only. Calls are counted per (variant, code) and laid out by code.
    """
    a = ds.selected_cells.select("variant_index", F.explode("g").alias("code"))
    per = a.groupBy("variant_index", "code").agg(F.count(F.lit(1)).alias("k"))
    per = per.groupBy("variant_index").agg(F.map_from_entries(F.collect_list(F.when(F.col("code").isNotNull(), F.struct("code", "k")))).alias("m"), F.sum("k").alias("rec"), F.sum(F.when(F.col("code").isNull(), F.col("k"))).alias("nm"))
    n = ds.ploidy * ds.n_samples
    v = ds.variants.select("variant_index", C.num_allele(F.col("allele")).alias("na")).join(per, "variant_index", "left")
    zero = n - F.coalesce("rec", F.lit(0))
    counts = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0)) + F.when(i == 0, zero).otherwise(0)).cast("long"))
    return v.select("variant_index", (n - F.coalesce("nm", F.lit(0))).cast("long").alias("n"), F.when(F.col("na") > 0, counts).otherwise(F.array().cast("array<bigint>")).alias("counts"))


def all_allele_freqs(ds: VariantDataset) -> DataFrame:
    """(variant_index, af): the frequency of every allele, nulls where all are missing."""
    return all_allele_counts(ds).select("variant_index", F.transform("counts", lambda k: F.try_divide(k.cast("double"), F.col("n").cast("double"))).alias("af"))


def missing_per_variant(ds: VariantDataset, dense: bool = False) -> DataFrame:
    return (dense_counts if dense else counts)(ds).select("variant_index", missing_rate().alias("missing"))


def missing_per_sample(ds: VariantDataset) -> DataFrame:
    """(sample_index, missing): missing alleles over ploidy x variants. Calls are summed by sample on the map side first."""
    per = ds.selected_cells.groupBy("sample_index").agg(F.sum(_n_missing(ds)).alias("_nm"))
    total = ds.ploidy * ds.n_variants
    return ds.samples.join(per, "sample_index", "left").select("sample_index", F.try_divide(F.coalesce("_nm", F.lit(0)).cast("double"), F.lit(float(total))).alias("missing"))


def missing_both(ds: VariantDataset) -> DataFrame:
    """(axis, ix, missing) of variants and samples from one aggregation of the calls over grouping sets."""
    per = ds.selected_cells.select("variant_index", "sample_index", _n_missing(ds).alias("nm")).groupingSets([["variant_index"], ["sample_index"]], "variant_index", "sample_index").agg(F.sum("nm").alias("nm"), F.grouping("variant_index").alias("g"))
    rate = lambda n: F.try_divide(F.coalesce("nm", F.lit(0)).cast("double"), F.lit(float(n)))
    v = ds.variants.select("variant_index").join(per.where("g = 0").select("variant_index", "nm"), "variant_index", "left")
    s = ds.samples.select("sample_index").join(per.where("g = 1").select("sample_index", "nm"), "sample_index", "left")
    return v.select(F.lit("variant").alias("axis"), F.col("variant_index").alias("ix"), rate(ds.ploidy * ds.n_samples).alias("missing")).unionByName(s.select(F.lit("sample").alias("axis"), F.col("sample_index").alias("ix"), rate(ds.ploidy * ds.n_variants).alias("missing")))


def _recorded_lists(ds: VariantDataset) -> bool:
    """Whether the recorded calls have lists of dosages, one an alternative allele."""
    return ds.calls is not None and ds.calls.schema["ds"].dataType.typeName() == "array"


def dosage_field(ds: VariantDataset) -> str | None:
    """The column with a list of dosages per sample (one an alternative allele), if there is one; else dosages are one a sample."""
    for f in ds.variants.schema.fields:
        if f.name in ("fmt_DS", "ds") and f.dataType.simpleString().startswith("array<array<"):
            return f.name
    return "ds" if _recorded_lists(ds) else None


def _finite(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _sum(a: Column) -> Column:
    return F.aggregate(_finite(a), F.lit(0.0), lambda s, x: s + x)


def ds_sums(ds: VariantDataset, alt: int = 0) -> DataFrame:
    """variants plus num (dosages that are there), total (their sum), m (columns) and cells (samples x columns).

    Of one column, from the recorded dosages (absent: 0) or the arrays; of lists per sample, pooled over all m columns,
    or with ``alt`` of that alternative allele alone (none beyond m). A variant without dosages has m = 1, all missing.
    """
    name = dosage_field(ds)
    if name == "ds" and _recorded_lists(ds):
        return _recorded_list_sums(ds, alt)
    if name is None and (ds.calls is not None or "ds" in ds.variants.columns):
        per = ds.selected_calls.groupBy("variant_index").agg(F.sum(F.col("ds").isNull().cast("long")).alias("_null"), F.sum("ds").alias("_sum")) if ds.calls is not None else None
        if per is None:
            v = ds.variants.withColumns({"num": F.size(_finite(F.col("ds"))).cast("long"), "total": _sum(F.col("ds"))})
        else:
            v = ds.variants.join(per, "variant_index", "left")
            v = v.withColumns({"num": (ds.n_samples - F.coalesce("_null", F.lit(0))).cast("long"), "total": F.coalesce("_sum", F.lit(0.0))}).drop("_null", "_sum")
        v = v.withColumns({"m": F.lit(1), "cells": F.lit(ds.n_samples).cast("long")})
        return v if alt <= 1 else v.withColumns({"num": F.lit(0).cast("long"), "total": F.lit(0.0)})
    if name is None:
        raise ValueError("this dataset has no dosages")
    rows = F.coalesce(F.transform(F.col(name), lambda x: x.cast("array<double>")), F.array().cast("array<array<double>>"))
    m = F.greatest(F.coalesce(F.array_max(F.transform(rows, lambda x: F.size(x))), F.lit(1)), F.lit(1))
    flat = F.flatten(F.transform(rows, lambda x: F.coalesce(x, F.array().cast("array<double>")))) if alt == 0 else F.transform(rows, lambda x: F.get(x, F.lit(alt - 1)))
    v = ds.variants.withColumn("m", m).withColumn("_flat", flat)
    v = v.withColumns({"num": F.size(_finite(F.col("_flat"))).cast("long"), "total": _sum(F.col("_flat")), "cells": (ds.n_samples * F.col("m")).cast("long")})
    return v.drop("_flat")


def _recorded_list_sums(ds: VariantDataset, alt: int) -> DataFrame:
    """ds_sums of recorded lists; a pair without a record has as many zeros as there are alternative alleles, one at least."""
    own = F.col("ds") if alt == 0 else F.array(F.get("ds", F.lit(alt - 1)))
    per = ds.selected_calls.groupBy("variant_index").agg(F.count(F.lit(1)).alias("_rec"), F.max(F.size("ds")).alias("_m"), F.sum(F.size(_finite(own)).cast("long")).alias("_num"), F.sum(_sum(own)).alias("_sum"))
    v = ds.variants.join(per, "variant_index", "left")
    absent = F.lit(ds.n_samples).cast("long") - F.coalesce("_rec", F.lit(0))
    zeros = F.greatest(C.num_allele(F.col("allele")) - 1, F.lit(1))
    v = v.withColumns({"m": F.greatest(F.coalesce("_m", F.lit(1)), F.when(absent > 0, zeros), F.lit(1)), "total": F.coalesce("_sum", F.lit(0.0))})
    v = v.withColumns({"num": F.coalesce("_num", F.lit(0)) + absent * (zeros if alt == 0 else (F.lit(alt) <= zeros).cast("int")), "cells": (ds.n_samples * F.col("m")).cast("long")})
    return v.drop("_rec", "_m", "_num", "_sum")


def _ds_freq(ds: VariantDataset, alt: int) -> Column:
    """Of ds_sums: the reference pools the columns, sum x m / (num x ploidy) from 1; another allele has its own column."""
    af = F.try_divide(F.col("total") * (F.col("m") if alt == 0 else F.lit(1)), F.col("num") * F.lit(float(ds.ploidy)))
    return 1 - af if alt == 0 else _of_known(ds, alt, af)


def _of_known(ds: VariantDataset, alt: int, x: Column) -> Column:
    """Null for an allele beyond the known ones; a single column is that of allele 1 whether it is known or not."""
    return F.when(F.lit(alt) < C.num_allele(F.col("allele")), x) if dosage_field(ds) else x


def ds_allele_freq(ds: VariantDataset, ref_allele: int = 0, minor: bool = False) -> DataFrame:
    """(variant_index, af) from dosages of any number of columns; an allele without a column or beyond the known ones is null."""
    af = _ds_freq(ds, ref_allele)
    return ds_sums(ds, ref_allele).select("variant_index", (F.when(af > 0.5, 1 - af).otherwise(af) if minor else af).alias("af"))


def ds_allele_count(ds: VariantDataset, ref_allele: int = 0, minor: bool = False) -> DataFrame:
    """(variant_index, ac): num x ploidy / m less the sum for the reference, the sum of its column for another allele."""
    whole = F.col("num") * F.lit(float(ds.ploidy)) / (F.col("m") if ref_allele == 0 else F.lit(1))
    ac = whole - F.col("total") if ref_allele == 0 else _of_known(ds, ref_allele, F.col("total"))
    return ds_sums(ds, ref_allele).select("variant_index", F.when(F.col("num") > 0, F.least(ac, whole - ac) if minor else ac).alias("ac"))


def ds_missing(ds: VariantDataset, per_variant: bool = True) -> DataFrame:
    """Share of samples x columns without a dosage per variant, or of variants with any missing dosage per sample."""
    if per_variant:
        return ds_sums(ds).select("variant_index", F.try_divide((F.col("cells") - F.col("num")).cast("double"), F.col("cells").cast("double")).alias("missing"))
    name = dosage_field(ds)
    if name is None:
        per = ds.selected_calls.groupBy("sample_index").agg(F.sum(F.col("ds").isNull().cast("long")).alias("_nm"))
    elif name == "ds" and _recorded_lists(ds):
        # A variant whose records are longer than the zeros of a pair without one lacks dosages in all of these.
        short = (F.col("m") > F.greatest(C.num_allele(F.col("allele")) - 1, F.lit(1))).cast("long").alias("_short")
        width = ds_sums(ds).select("variant_index", "m", short)
        bad = (F.coalesce(F.size(_finite(F.col("ds"))), F.lit(0)) < F.col("m")).cast("long")
        per = ds.selected_calls.join(width, "variant_index").groupBy("sample_index").agg(F.sum(bad - F.col("_short")).alias("_own"))
        per = ds.samples.select("sample_index").join(per, "sample_index", "left").crossJoin(F.broadcast(width.agg(F.coalesce(F.sum("_short"), F.lit(0)).alias("_all")))).select("sample_index", (F.coalesce("_own", F.lit(0)) + F.col("_all")).alias("_nm"))
    else:
        # Counted per place in the arrays, added up on the map side first.
        rows = ds.variants.select(F.posexplode(F.transform(F.coalesce(F.col(name), F.array_repeat(F.lit(None).cast("array<double>"), ds.n_samples)), lambda x: (F.coalesce(F.size(_finite(x.cast("array<double>"))), F.lit(0)) < F.greatest(F.coalesce(F.array_max(F.transform(F.col(name), lambda y: F.size(y))), F.lit(1)), F.lit(1))).cast("long"))).alias("_p", "_bad"))
        per = rows.groupBy("_p").agg(F.sum("_bad").alias("_nm")).withColumn("_s", F.col("_p") + 1).join(ds._places(), "_s").select("sample_index", "_nm")
    return ds.samples.join(per, "sample_index", "left").select("sample_index", F.try_divide(F.coalesce("_nm", F.lit(0)).cast("double"), F.lit(float(ds.n_variants))).alias("missing"))


def ds_af_ac_missing(ds: VariantDataset, minor: bool = False, alt: bool = False, ns: bool = False) -> DataFrame:
    """(variant_index, af, ac, miss[, ns]) from dosages in one pass; ``alt`` turns to the other alleles before ``minor`` folds."""
    af = _ds_freq(ds, 0)
    af = 1 - af if alt else af
    whole = F.col("num") * F.lit(float(ds.ploidy)) / F.col("m")
    ac = F.col("total") if alt else whole - F.col("total")
    ac = F.least(ac, whole - ac) if minor else ac
    miss = F.try_divide((F.col("cells") - F.col("num")).cast("double"), F.col("cells").cast("double"))
    cols = [(F.when(af > 0.5, 1 - af).otherwise(af) if minor else af).alias("af"), F.when(F.col("num") > 0, ac).alias("ac"), miss.alias("miss")]
    if ns:
        cols.append(F.bround(F.lit(float(ds.n_samples)) * (1 - miss), 0).cast("long").alias("ns"))
    return ds_sums(ds).select("variant_index", *cols)


def dosage_matrix_freq(dosages: Column, ploidy: int = 2, alt_index: int = 0, m: int = 1) -> Column:
    """Allele frequency from an array (alt allele) of arrays (sample) of dosages; alt_index 0 is the reference.

    The reference pools the columns: 1 - sum x m / (num x ploidy), where num counts all cells of the m columns.
    """
    finite = lambda a: F.filter(a, lambda x: x.isNotNull() & ~F.isnan(x))
    total = lambda a: F.aggregate(finite(a), F.lit(0.0), lambda s, x: s + x)
    if alt_index == 0:
        flat = F.flatten(dosages)
        return 1 - F.try_divide(total(flat) * m, F.size(finite(flat)) * F.lit(float(ploidy)))
    one = F.get(dosages, alt_index - 1)
    return F.try_divide(total(one), F.size(finite(one)) * F.lit(float(ploidy)))


def af_ac_missing(ds: VariantDataset, minor: bool = False, alt: bool = False, ns: bool = False, dense: bool = False, coded: bool = False) -> DataFrame:
    """(variant_index, af, ac, miss[, ns]) in one pass; ``alt`` turns to the other alleles before ``minor`` folds.

    ns, the samples with a genotype, is rounded half to even.
    """
    n = (coded_counts if coded else dense_counts if dense else counts)(ds)
    if alt:
        n = n.withColumn("n_allele", F.col("n_total") - F.col("n_missing") - F.col("n_allele"))
    cols = [frequency(minor).alias("af"), count(minor).alias("ac"), missing_rate().alias("miss")]
    if ns:
        cols.append(F.bround(F.lit(float(ds.n_samples)) * (1 - missing_rate()), 0).cast("long").alias("ns"))
    return n.select("variant_index", *cols)
