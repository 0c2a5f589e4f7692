"""Units: lists of variants, from sliding windows or given."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..session import workers
from . import stats as S
from .filters import condition, numbered


def sliding_windows(variants: DataFrame, size: int = 5000, shift: int = 2500, start: int = 0, dup_rm: bool = True) -> DataFrame:
    """(chromosome, start, end, index): windows [s, s + size) for s = start, start + shift, ... over each chromosome.

    Each variant is dealt to the windows that hold it. Windows go on until all positions of the chromosome lie before the
    next one's start. With ``dup_rm``, empty windows and those equal to the window kept before are left out; without it,
    all windows up to the last are given, with their real members.
    """
    p = F.col("position") - start
    # Windows k with k * shift <= p < k * shift + size.
    first = F.greatest(F.floor((p - size).cast("double") / shift) + 1, F.lit(0))
    last = F.floor(p.cast("double") / shift)
    v = variants.where(p >= 0).withColumn("_k", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    w = v.groupBy("chromosome", "_k").agg(F.array_sort(F.collect_list("variant_index")).alias("index"))
    if dup_rm:
        # A variant's windows follow one another, so a window differs from the one before where a variant enters or has left.
        changes = variants.where(p >= 0).where(first <= last).select("chromosome", F.explode(F.array(first, last + 1)).alias("_k")).distinct()
        w = w.join(changes, ["chromosome", "_k"], "left_semi")
    else:
        top = variants.where(p >= 0).groupBy("chromosome").agg(F.max("position").alias("_top"))
        every = top.select("chromosome", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.floor((F.col("_top") - start - size + 1 + shift - 1).cast("double") / shift), F.lit(0)))).alias("_k"))
        w = every.join(w, ["chromosome", "_k"], "left").withColumn("index", F.coalesce("index", F.array().cast("array<int>")))
    s = (start + F.col("_k") * shift).cast("int")
    return w.select("chromosome", s.alias("start"), (s + size - 1).cast("int").alias("end"), "index")


def number_units(units: DataFrame, variants: DataFrame | None = None) -> DataFrame:
    """units with unit_ix: chromosomes in order of first appearance, then by start."""
    if variants is None:
        order = ["chromosome", "start"]
        u = units
    else:
        first = variants.groupBy("chromosome").agg(F.min("variant_index").alias("_first"))
        u, order = units.join(first, "chromosome", "left"), ["_first", "start"]
    # Numbered within chromosomes; chromosome totals, a handful of rows, are summed up in order.
    per = u.groupBy(order[0]).agg(F.count(F.lit(1)).alias("_n"))
    before = per.select(order[0], F.coalesce(F.sum("_n").over(Window.orderBy(order[0]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    u = u.join(before, order[0]).withColumn("unit_ix", (F.col("_before") + F.row_number().over(Window.partitionBy(order[0]).orderBy(order[1]))).cast("long"))
    return u.drop("_before", "_first")


def create(spark, index: Iterable[Iterable[int | None]], chromosome: Iterable | None = None) -> DataFrame:
    """Units from lists of 1-based indices; nulls and numbers below 1 are dropped."""
    index = [list(x) for x in index]
    names = list(chromosome) if chromosome is not None else [None] * len(index)
    u = spark.createDataFrame([(i + 1, c, x) for i, (c, x) in enumerate(zip(names, index, strict=True))], "unit_ix long, chromosome string, index array<int>")
    return u.withColumn("index", F.filter("index", lambda x: x >= 1))


def subset(units: DataFrame, which: Iterable[int] | Iterable[bool | None]) -> DataFrame:
    which = list(which)
    keep = [i + 1 for i, x in enumerate(which) if x] if all(isinstance(x, bool) or x is None for x in which) else [int(i) for i in which]
    return units.where(F.col("unit_ix").isin(keep))


def merge(*units: DataFrame) -> DataFrame:
    """The units one after the other, numbered anew."""
    out, offset = None, F.lit(0).cast("long")
    for u in units:
        part = u.withColumn("unit_ix", F.col("unit_ix") + offset)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        offset = F.lit(out.agg(F.max("unit_ix")).first()[0] or 0)
    return out


def set_diff(a: DataFrame, b: DataFrame, key: Iterable[str] = ("chromosome", "start", "end"), by_name: bool = False, drop: bool = True) -> DataFrame:
    """Members of each unit of a without those of the unit of b with the same key (``by_name``: the first of b with its chromosome)."""
    key = ["chromosome"] if by_name else list(key)
    if by_name:
        b = b.groupBy("chromosome").agg(F.min_by("index", "unit_ix").alias("_take"))
    else:
        b = b.groupBy(*key).agg(F.flatten(F.collect_list("index")).alias("_take"))
    d = a.join(b, key, "left").withColumn("index", F.when(F.col("_take").isNull(), F.col("index")).otherwise(F.array_except("index", "_take"))).drop("_take")
    return d.where(F.size("index") > 0) if drop else d


def filter_condition(ds: VariantDataset, units: DataFrame, maf=None, mac=1, missing_rate=None, minsize: int = 1) -> DataFrame:
    """Units with only the members that meet the condition, without units smaller than minsize; each variant is counted once."""
    good = S.counts(ds).where(condition(maf, mac, missing_rate)).select("variant_index")
    keys = [c for c in units.columns if c != "index"]
    kept = units.select(*keys, F.explode("index").alias("variant_index")).join(good, "variant_index", "left_semi")
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list("variant_index")).alias("index")).where(F.size("index") >= minsize)


def unit_stats(units: DataFrame) -> DataFrame:
    """Number of units and distinct variants, and mean, median, least, most and deviation of the sizes."""
    n = F.size("index")
    a = units.agg(F.count(F.lit(1)).alias("n_units"), F.avg(n).alias("mean"), F.median(n).alias("median"), F.min(n).alias("min"), F.max(n).alias("max"), F.stddev_samp(n).alias("sd"))
    d = units.select(F.explode("index").alias("i")).distinct().agg(F.count(F.lit(1)).alias("n_variants"))
    return a.crossJoin(d)


def unit_apply(units: DataFrame, rows: DataFrame, function: Callable, schema: str) -> DataFrame:
    """function(key, pandas frame of a unit's variants), or of the frame alone, for every unit; units may overlap, a variant goes to each that lists it.

    Units are dealt to a given number of tasks, as the planner sees few bytes and would make one task of them, and come
    sorted in whole batches: a task holds a batch and the unit that goes on in the next one.
    """
    listed = units.select("unit_ix", F.explode("index").alias("variant_index")).join(rows, "variant_index")
    with_key = len(inspect.signature(function).parameters) > 1

    def of_unit(f):
        f = f.reset_index(drop=True)
        return function((f["unit_ix"].iloc[0],), f) if with_key else function(f)

    def run(frames):
        import numpy as np
        import pandas as pd

        held = []
        for f in frames:
            if not len(f):
                continue
            key = f["unit_ix"].to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1), len(f)]
            parts = [f.iloc[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            done = []
            if held and held[0]["unit_ix"].iloc[0] != key[0]:
                done.append(pd.concat(held) if len(held) > 1 else held[0])
                held = []
            for p in parts[:-1]:
                done.append(pd.concat([*held, p]) if held else p)
                held = []
            held.append(parts[-1])
            got = [x for x in map(of_unit, done) if len(x)]
            if got:
                yield pd.concat(got, ignore_index=True)
        if held:
            yield of_unit(pd.concat(held))

    return listed.repartition(16 * workers(units.sparkSession), "unit_ix").sortWithinPartitions("unit_ix").mapInPandas(run, schema)


def blocks(variants: DataFrame, size: int = 1024) -> DataFrame:
    """variants with block, the tumbling block of ``size`` selected variants that each is in, from 1."""
    return numbered(variants, "variant_index").withColumn("block", (F.floor((F.col("_rank") - 1) / size) + 1).cast("long")).drop("_rank")


def block_apply(variants: DataFrame, function: Callable, schema: str, size: int = 1024) -> DataFrame:
    """function(pandas frame of a block, in order) for every block."""
    return blocks(variants, size).groupBy("block").applyInPandas(lambda f: function(f.sort_values("variant_index")), schema)
