"""User functions over variants, samples, blocks and parts.

Built-in expressions are the first choice; these run Python on Arrow batches where a
function is arbitrary. A function gets whole batches, never single rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import add
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from .filters import numbered

_KINDS = {"integer": "long", "double": "double", "character": "string", "logical": "boolean", "raw": "binary"}


def apply_variants(ds: VariantDataset, columns: str | list[str], function: Callable[..., Any], as_is: str = "double", var_index: str = "none") -> DataFrame:
    """(variant_index, value): function of one variant's column, or of a dict of several; as a scalar type or "list:<type>".

    With ``var_index`` "relative" or "absolute", the place in the selection or in the file is the first argument.
    """
    names = [columns] if isinstance(columns, str) else list(columns)
    rows = ds.variants
    if var_index == "relative":
        rows = numbered(rows, "variant_index")
    index = "_rank" if var_index == "relative" else "variant_index"
    rows = rows.select("variant_index", *({index} - {"variant_index"}), *[n for n in names if n != "variant_index"])
    kind = f"array<{_KINDS.get(as_is[5:], as_is[5:])}>" if as_is.startswith("list:") else _KINDS.get(as_is, as_is)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            values = []
            for r in f.to_dict("records"):
                x = r[names[0]] if isinstance(columns, str) else {n: r[n] for n in names}
                values.append(function(x) if var_index == "none" else function(int(r[index]), x))
            yield pd.DataFrame({"variant_index": f["variant_index"], "value": pd.Series(values, dtype=object if values else None, index=f.index)})

    return rows.mapInPandas(run, f"variant_index int, value {kind}")


def apply_samples(ds: VariantDataset, function: Callable[[pd.DataFrame], Any], schema: str = "sample_index int, value double", recorded_only: bool = False) -> DataFrame:
    """function(frame of a sample's cells) -> frame; all cells by default, the recorded calls only if asked for."""
    return (ds.selected_calls if recorded_only else ds.cells().drop("g") if ds.ploidy == 2 else ds.cells()).groupBy("sample_index").applyInPandas(function, schema)


def parallel(ds: VariantDataset, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, split: str = "by.variant", parts: int | None = None) -> DataFrame:
    """function over parts of the selection, results as rows (combine: list or unlist); parts follow the file's order."""
    rows, key = (ds.variants, "variant_index") if split == "by.variant" else (ds.samples, "sample_index")
    rows = rows.repartitionByRange(parts, key) if parts else rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = list(frames)
        if each:
            yield function(pd.concat(each).sort_values(key))

    return rows.mapInPandas(run, schema)


def parallel_apply(ds: VariantDataset, function: Callable[..., Any], split: str = "by.variant", combine_by: str | Callable[[Any, Any], Any] | None = "unlist", parts: int | None = None) -> Any:
    """function over parts of the selection, its results combined on the driver, which gets one value a part.

    ``split``: "by.variant" or "by.sample" hands each part's frame, "none" the numbers 1 to parts. ``combine_by``:
    "unlist" (one flat list, in the parts' order), "list", "+" or a function of two (a fold in order), None (no result:
    the function runs for what it does).
    """
    spark = ds.spark
    n = parts or max(2, spark.sparkContext.defaultParallelism)
    if split == "none":
        rows = spark.range(1, n + 1, 1, n).select(F.col("id").alias("_place"))
    else:
        table, key = (ds.variants, "variant_index") if split == "by.variant" else (ds.samples, "sample_index")
        rows = table.repartitionByRange(n, key).withColumn("_place", F.col(key).cast("long"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each = [f for f in frames if len(f)]
        if each:
            f = pd.concat(each).sort_values("_place")
            got = [function(int(i)) for i in f["_place"]] if split == "none" else [function(f.drop(columns="_place"))]
            places = f["_place"] if split == "none" else f["_place"].iloc[:1]
            yield pd.DataFrame({"place": list(places), "value": [pickle.dumps(x if combine_by is not None else None) for x in got]})

    got = [pickle.loads(bytes(r["value"])) for r in sorted(rows.mapInPandas(run, "place long, value binary").collect(), key=lambda r: r["place"])]
    if combine_by is None:
        return None
    if combine_by == "list":
        return got
    if combine_by == "unlist":
        return [y for x in got for y in (x if isinstance(x, list | tuple) else [x])]
    return reduce(add if combine_by == "+" else combine_by, got) if got else None


def write_lines(values: DataFrame, path: str) -> None:
    """Write (variant_index, value) as text, one line a value in the order of the variants; lists as comma-separated values."""
    kind = values.schema["value"].dataType.typeName()
    text = F.array_join(F.col("value").cast("array<string>"), ",", "NA") if kind == "array" else F.coalesce(F.col("value").cast("string"), F.lit("NA"))
    values.select("variant_index", text.alias("_line")).orderBy("variant_index").select("_line").write.mode("overwrite").text(path)


def write_raw(values: DataFrame, path: str, kind: str = "<i4") -> None:
    """Write (variant_index, value) as little-endian bytes, (variant_index, raw) in Parquet sorted by variant; lists value by value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"variant_index": f["variant_index"], "raw": [np.atleast_1d(np.asarray(x)).astype(kind).tobytes() for x in f["value"]]})

    values.orderBy("variant_index").mapInPandas(run, "variant_index int, raw binary").write.mode("overwrite").parquet(path)


def combine(partials: DataFrame, column: str, how: str | Callable[[Any, Any], Any] = "+"):
    """One value from partial results: "+" sums in Spark; an associative function is folded over partitions, then over those."""
    if how == "+":
        return partials.agg(F.sum(column)).first()[0]
    return partials.select(column).rdd.map(lambda r: r[0]).treeReduce(how)


def par_apply(spark, items: Iterable[Any], function: Callable[[Any], Any], parts: int | None = None) -> list[Any]:
    """[function(x) for x in items], on the cluster."""
    items = list(items)
    return spark.sparkContext.parallelize(items, parts or max(1, min(len(items), spark.sparkContext.defaultParallelism))).map(function).collect() if items else []


def process_parts(rows: DataFrame) -> DataFrame:
    """(process_index, process_count, n): which part of the rows each process holds."""
    n = rows.rdd.getNumPartitions()
    return rows.groupBy((F.spark_partition_id() + 1).alias("process_index")).agg(F.count(F.lit(1)).alias("n")).withColumn("process_count", F.lit(n))
