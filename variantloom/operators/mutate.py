"""Adding, replacing and deleting data."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..session import shared_dir

_FIXED = {"position": "int", "chromosome": "string", "allele": "string"}
_NOTES = {"annotation/id": "id", "annotation/qual": "qual", "annotation/filter": "filter"}


def _joined(rows: DataFrame, key: str, name: str, value: Column | DataFrame | list, n: int, kind: str | None = None) -> DataFrame:
    """rows with a column from an expression, a table (key, value), or a list with one value a row in order."""
    if isinstance(value, Column):
        return rows.withColumn(name, value.cast(kind) if kind else value)
    if not isinstance(value, DataFrame):
        values = list(value)
        if len(values) != n:
            raise ValueError(f"{name} has {len(values)} values for {n} rows")
        from .filters import numbered

        table = rows.sparkSession.createDataFrame([(i + 1, x) for i, x in enumerate(values)], f"_rank long, _value {kind}" if kind else ["_rank", "_value"])
        return numbered(rows.drop(name), key).join(table, "_rank", "left").withColumnRenamed("_value", name).drop("_rank")
    v = value.columns[-1]
    table = value.select(F.col(value.columns[0]).alias(key), (F.col(v).cast(kind) if kind else F.col(v)).alias(name))
    return rows.drop(name).join(table, key, "left")


def add_value(ds: VariantDataset, name: str, value: Any, replace: bool = False, kind: str | None = None) -> VariantDataset:
    """Set data by name: an expression over the rows, a table (index, value), a list in order, or None for an empty folder.

    sample.id and variant.id have to stay unique; position, chromosome and allele need ``replace``; data that is there is
    only overwritten with ``replace``. annotation/info/X becomes the column X of variants, sample.annotation/X of samples.
    """
    if name in ("annotation/info", "annotation/format") or value is None:
        return ds
    if name == "sample.id" or name.startswith("sample.annotation/"):
        col = "sample_id" if name == "sample.id" else name.removeprefix("sample.annotation/")
        if name != "sample.id" and col in ds.samples.columns and not replace:
            raise ValueError(f"{name} is there; replace it")
        s = _joined(ds.samples, "sample_index", col, value, ds.n_samples if isinstance(value, list | tuple) else 0, kind or ("string" if col == "sample_id" else None))
        if col == "sample_id" and not s.groupBy("sample_id").count().where("count > 1 or sample_id is null").isEmpty():
            raise ValueError("sample.id has to be unique")
        return ds.with_(samples=s)
    if name == "sample.annotation":
        return ds.with_(samples=ds.samples.select("sample_index", "sample_id").join(value, "sample_id", "left"))
    n = ds.n_variants if isinstance(value, list | tuple) else 0
    if name == "variant.id":
        v = _joined(ds.variants, "variant_index", "variant_id", value, n, kind or "long")
        if not v.groupBy("variant_id").count().where("count > 1 or variant_id is null").isEmpty():
            raise ValueError("variant.id has to be unique")
        return ds.with_(variants=v)
    if name in _FIXED:
        if not replace:
            raise ValueError(f"{name} is there; replace it")
        return ds.with_(variants=_joined(ds.variants, "variant_index", name, value, n, _FIXED[name]))
    col = _NOTES.get(name) or (name.removeprefix("annotation/info/") if name.startswith("annotation/info/") else None)
    if col is None:
        raise ValueError(f"{name} cannot be set")
    if col in ds.variants.columns and not replace:
        raise ValueError(f"{name} is there; replace it")
    if isinstance(value, dict):
        return ds.with_(variants=ds.variants.withColumn(col, F.struct(*[x.alias(k) for k, x in value.items()])))
    return ds.with_(variants=_joined(ds.variants, "variant_index", col, value, n, kind))


def add_stream(ds: VariantDataset, name: str, function: Callable[[Iterator], Iterator], kind: str) -> VariantDataset:
    """annotation/info/X from a function over blocks: an iterator of frames of variants to frames (variant_index, value).

    Blocks are made and written as they come, so the function runs once; as many values as variants have to come out.
    """
    col = name.removeprefix("annotation/info/")
    path = f"{shared_dir(ds.spark)}/variantloom/stream-{uuid.uuid4().hex}"
    ds.variants.mapInPandas(function, f"variant_index int, value {kind}").write.parquet(path)
    made = ds.spark.read.schema(f"variant_index int, value {kind}").parquet(path)
    if made.count() != ds.n_variants or not made.groupBy("variant_index").count().where("count > 1").isEmpty():
        raise ValueError(f"{name} needs one value for every variant")
    return add_value(ds, f"annotation/info/{col}", made, replace=True)


def delete(ds: VariantDataset, info: Iterable[str] = (), fmt: Iterable[str] = (), samp: Iterable[str] = ()) -> VariantDataset:
    """Without these fields of variants, calls and samples; an unknown name is an error."""
    for names, rows in ((list(info), ds.variants), (list(samp), ds.samples)):
        if missing := [n for n in names if n not in rows.columns]:
            raise KeyError(f"no such field: {', '.join(missing)}")
    calls = ds.calls
    if calls is not None:
        calls = reduce(lambda c, n: c.withColumn(n, F.lit(None).cast(c.schema[n].dataType)), fmt, calls)
    return ds.with_(variants=ds.variants.drop(*info, *fmt), samples=ds.samples.drop(*samp), calls=calls)


def append_fill(rows: DataFrame, name: str, value: Any) -> DataFrame:
    return rows.withColumn(name, F.lit(value))


#: Calls that a task of sample_major sorts, on average.
CALLS_A_TASK = 1_000_000


def sample_major(ds: VariantDataset, path: str, buckets: int = 64) -> None:
    """Write the calls once more, dealt and sorted by sample, so that reads of a few samples skip the rest.

    A bucket is a multiple of tasks and files if its calls are many, so that no task sorts more as the table grows.
    """
    c = ds.selected_calls if ds.ploidy == 2 else ds.selected_cells
    n = buckets * max(1, -(-c.count() // (buckets * CALLS_A_TASK)))
    c.repartitionById(n, F.pmod("sample_index", F.lit(n)).cast("int")).sortWithinPartitions("sample_index", "variant_index").write.mode("overwrite").parquet(path)
