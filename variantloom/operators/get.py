"""One entry to data by name (P1-P12, D1-D14, U1 names): stored, derived and external variables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C

_FIXED = {"variant.id": "variant_id", "allele": "allele", "annotation/id": "id", "annotation/qual": "qual", "annotation/filter": "filter", "position": "position", "chromosome": "chromosome"}
#: FORMAT fields that a dense dataset keeps in columns of their own.
_FORMAT = {"DP": "dp", "DS": "ds"}


def _scalars() -> Mapping[str, Column]:
    a, c, p = F.col("allele"), F.col("chromosome"), F.col("position")
    return {"$num_allele": C.num_allele(a), "$ref": C.ref(a), "$alt": C.alt(a), "$chrom_pos": C.chrom_pos(c, p), "$chrom_pos_allele": C.chrom_pos_allele(c, p, a), "$variant_index": F.col("variant_index"), "@genotype": C.genotype_layers(C.num_allele(a))}


def recorded_dosage(ds: VariantDataset, name: str) -> tuple[Column, Column]:
    """The dosage of a recorded call, and that of a pair without one."""
    f = {"$dosage": C.cell_dosage, "$dosage_alt": C.cell_dosage_alt, "$dosage_alt2": C.cell_dosage_alt2}[name]
    return f(ds._codes), F.lit(ds.ploidy if name == "$dosage" else 0)


def get(ds: VariantDataset, name: str, external: Mapping[str, DataFrame] | None = None, pad: bool = True) -> DataFrame:
    """The variable as a table: (variant_index, value) or (sample_index, value); runs and sparse forms have their own columns.

    * ``sample.id``, ``sample.annotation/X``, ``$sample_index``: of samples;
    * ``variant.id``, ``position``, ``chromosome``, ``allele``, ``annotation/id``, ``.../qual``, ``.../filter``: stored columns;
    * ``genotype``, ``phase``, ``annotation/format/X`` and ``@X``: arrays in sample order, and numbers of values;
    * ``annotation/info/X`` and ``@X``: values (with ``pad``, arrays of one value at most become that value) and lengths;
    * ``$dosage``, ``$dosage_alt``, ``$dosage_alt2``, ``$dosage_sp``, ``$dosage_sp2``, ``$chromosome``, ``$chrom_pos2`` and
      the other ``$`` names: derived; ``$:X``: a table (variant_index, value) given in ``external``.
    """
    v, s, i = ds.variants, ds.samples, "variant_index"
    if name == "sample.id":
        return s.select("sample_index", F.col("sample_id").alias("value"))
    if name == "$sample_index":
        return s.select("sample_index", F.col("sample_index").alias("value"))
    if name.startswith("sample.annotation/"):
        return s.select("sample_index", F.col(_known(s, name.removeprefix("sample.annotation/"))).alias("value"))
    if name in _FIXED:
        return v.select(i, F.col(_FIXED[name]).alias("value"))
    if name == "$chromosome":
        return C.chromosome_runs(v)
    if name == "$chrom_pos2":
        return C.chrom_pos2(v).select(i, F.col("chrom_pos2").alias("value"))
    if name in ("genotype", "phase"):
        return ds.dense().variants.select(i, F.col("gt" if name == "genotype" else "phase").alias("value"))
    if name in ("$dosage", "$dosage_alt", "$dosage_alt2"):
        if ds.calls is not None and not {"gt", "gs"} & set(v.columns):
            return ds.per_sample(*recorded_dosage(ds, name)).select(i, "value")
        f = {"$dosage": C.dosage, "$dosage_alt": C.dosage_alt, "$dosage_alt2": C.dosage_alt2}[name]
        return ds.dense().variants.select(i, f(F.col("gt"), ds.ploidy).alias("value"))
    if name in ("$dosage_sp", "$dosage_sp2"):
        if ds.ploidy == 2:
            f = C.call_dosage_alt if name == "$dosage_sp" else C.call_dosage_alt2
            return C.sparse_entries(ds.selected_calls, f(F.col("a1"), F.col("a2")))
        f = C.cell_dosage_alt if name == "$dosage_sp" else C.cell_dosage_alt2
        return C.sparse_entries(ds.selected_cells, f(F.col("g")))
    if name.startswith("annotation/info/"):
        x = name.removeprefix("annotation/info/")
        column = _known(v, x.removeprefix("@"))
        kind = v.schema[column].dataType.typeName()
        if x.startswith("@"):
            return v.select(i, (F.size(column) if kind == "array" else F.lit(1)).alias("value"))
        if kind == "array" and pad and v.where(F.size(column) > 1).isEmpty():
            return v.select(i, F.get(column, F.lit(0)).alias("value"))
        return v.select(i, F.col(column).alias("value"))
    if name.startswith("annotation/format/"):
        x = name.removeprefix("annotation/format/")
        field = x.removeprefix("@")
        if x.startswith("@") and field in _FORMAT and ds.calls is not None:
            # Counted from the calls; a pair without a record has a dosage, but no depth.
            per = ds.selected_calls.groupBy(i).agg(F.count(F.lit(1)).alias("_rec"), F.count(_FORMAT[field]).alias("_n"))
            rest = ds.n_samples - F.coalesce("_rec", F.lit(0)) if field == "DS" else F.lit(0)
            return v.select(i).join(per, i, "left").select(i, (F.coalesce("_n", F.lit(0)) + rest).cast("int").alias("value"))
        rows = ds.dense().variants if ds.calls is not None else v
        column = _known(rows, _FORMAT.get(field, field) if _FORMAT.get(field, field) in rows.columns else f"fmt_{field}")
        return rows.select(i, (F.size(F.array_compact(column)) if x.startswith("@") else F.col(column)).alias("value"))
    if name.startswith("$:"):
        table = (external or {})[name[2:]]
        return v.select(i).join(table.select(F.col(table.columns[0]).alias(i), F.col(table.columns[-1]).alias("value")), i, "left")
    scalars = _scalars()
    if name not in scalars:
        raise KeyError(f"no such variable: {name}")
    return v.select(i, scalars[name].alias("value"))


def get_text(ds: VariantDataset, name: str) -> DataFrame:
    """(variant_index, value): the arrays of get() as text, values joined by commas and nulls as '.'; truth values as 0 and 1.

    From recorded calls, runs of equal values are repeated as text; arrays are joined value by value.
    """
    shown = lambda x: F.coalesce(x.cast("string"), F.lit("."))
    bits = lambda x: x.cast("int") if name == "phase" else x
    if ds.calls is None or {"gt", "gs"} & set(ds.variants.columns):
        return get(ds, name).select("variant_index", F.array_join(F.transform("value", lambda x: shown(bits(x))), ",").alias("value"))
    if name == "genotype":
        cell, fill = F.array_join(F.transform(ds._codes, shown), ","), ",".join("0" * ds.ploidy)
    elif name in ("$dosage", "$dosage_alt", "$dosage_alt2"):
        cell, fill = shown(recorded_dosage(ds, name)[0]), str(ds.ploidy if name == "$dosage" else 0)
    else:
        column, fill = {"phase": ("phase", "0"), "annotation/format/DP": ("dp", "."), "annotation/format/DS": ("ds", "0.0")}[name]
        cell = shown(bits(F.col(column)))
    return ds.per_sample_text(cell, fill).select("variant_index", "value")


def _known(rows: DataFrame, column: str) -> str:
    if column not in rows.columns:
        raise KeyError(f"no such field: {column}")
    return column


def get_many(ds: VariantDataset, names: list[str]) -> DataFrame:
    """Several variables of variants side by side, one column each under its name; shared scans are one scan."""
    out = ds.variants.select("variant_index")
    for n in names:
        out = out.join(get(ds, n).withColumnRenamed("value", n), "variant_index", "left")
    return out
