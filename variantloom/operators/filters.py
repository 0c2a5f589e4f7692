"""Selections: by id, index, flag, chromosome, range, position and condition.

A selection is a smaller dataset. Small lists of ids are joined as semi joins, whose
side Spark broadcasts by its own size estimate; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C
from . import stats as S

MAX_POSITION = 2**31 - 1


class FilterStack:
    """A stack of selections over one dataset: the current one is on top."""

    def __init__(self, full: VariantDataset):
        self.full, self._stack = full, [full]

    @property
    def current(self) -> VariantDataset:
        return self._stack[-1]

    def set(self, ds: VariantDataset, action: str = "set") -> VariantDataset:
        """Replace the top ("set", "intersect") or lay a new one on it ("push", "push+set", "push+intersect"); "pop" drops it."""
        if action == "pop":
            return self.pop()
        if action.startswith("push"):
            self._stack.append(self.current)
        if action != "push":
            self._stack[-1] = ds
        return self.current

    def push(self, reset: bool = False) -> VariantDataset:
        self._stack.append(self.full if reset else self.current)
        return self.current

    def pop(self) -> VariantDataset:
        if len(self._stack) == 1:
            raise IndexError("no filter to pop")
        self._stack.pop()
        return self.current

    def reset(self, variants: bool = True, samples: bool = True) -> VariantDataset:
        c, f = self.current, self.full
        meta = {k: v for k, v in c.meta.items() if not (variants and k == "variants_filtered") and not (samples and k == "samples_filtered")}
        self._stack[-1] = f if variants and samples else f.filtered(samples=c.samples) if variants else f.filtered(variants=c.variants) if samples else c.with_(meta=meta)
        return self.current


def _ids(ds: VariantDataset, ids, name: str, kind: str) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col(ids.columns[0]).cast(kind).alias(name)).distinct()
    return ds.spark.createDataFrame([(x,) for x in dict.fromkeys(ids) if x is not None] or [], f"{name} {'string' if kind == 'string' else 'long'}").select(F.col(name).cast(kind).alias(name))


def by_variant_id(ds: VariantDataset, ids: Iterable | DataFrame) -> VariantDataset:
    return ds.filtered(variants=ds.variants.join(_ids(ds, ids, "variant_id", ds.variants.schema["variant_id"].dataType.simpleString()), "variant_id", "left_semi"))


def by_sample_id(ds: VariantDataset, ids: Iterable | DataFrame) -> VariantDataset:
    """Numbers are compared as text where ids are text."""
    if not isinstance(ids, DataFrame):
        ids = [None if x is None else str(x) for x in ids]
    return ds.filtered(samples=ds.samples.join(_ids(ds, ids, "sample_id", "string"), "sample_id", "left_semi"))


def by_index(ds: VariantDataset, index: Iterable[int] | DataFrame, axis: str = "variant", intersect: bool = False) -> VariantDataset:
    """1-based indices into the file, or with ``intersect`` into the current selection; order and repeats do not matter.

    An index beyond the selection is an error, null is passed over.
    """
    key, rows = f"{axis}_index", getattr(ds, f"{axis}s")
    if not isinstance(index, DataFrame):
        wanted = [i for i in index if i is not None]
        if any(i < 1 for i in wanted) or intersect and any(i > (ds.n_variants if axis == "variant" else ds.n_samples) for i in wanted):
            raise IndexError("index out of range")
        index = _ids(ds, wanted, "_i", "int")
    else:
        index = index.select(F.col(index.columns[0]).cast("int").alias("_i")).distinct()
    if intersect:
        rows = numbered(rows, key)
    kept = rows.join(index, F.col("_rank") == F.col("_i") if intersect else F.col(key) == F.col("_i"), "left_semi").drop("_rank")
    return ds.filtered(**{f"{axis}s": kept})


def numbered(rows: DataFrame, key: str, first: str | None = None) -> DataFrame:
    """rows with _rank, the place in order of ``key`` (of ``first``, then ``key``), without bringing all rows into one task.

    Rows are counted by blocks of the key; only the block counts are summed up in order.
    """
    by = [first, "_b"] if first else ["_b"]
    ranked = rows.withColumn("_b", (F.col(key) / 65536).cast("long"))
    per = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = per.select(*by, F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = ranked.withColumn("_in", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    return ranked.join(before, by).withColumn("_rank", (F.col("_before") + F.col("_in")).cast("long")).drop("_b", "_in", "_before")


def by_flag(ds: VariantDataset, flag: Column | Sequence[bool | None], axis: str = "variant", intersect: bool = False) -> VariantDataset:
    """Rows whose flag is true (null is false): an expression over the rows, or one flag per row in order."""
    if isinstance(flag, Column):
        return ds.filtered(**{f"{axis}s": getattr(ds, f"{axis}s").where(F.coalesce(flag, F.lit(False)))})
    return by_index(ds, [i + 1 for i, x in enumerate(flag) if x], axis, intersect)


def by_annotation_id(full: VariantDataset, ds: VariantDataset, ids: Iterable[str]) -> VariantDataset:
    """Variants with one of these ids, of the whole file: this replaces the current selection of variants."""
    return ds.filtered(variants=full.variants.join(_ids(full, ids, "id", "string"), "id", "left_semi"))


def merged_ranges(ranges: Iterable[tuple]) -> list[tuple[str, int, int]]:
    """Union of (chromosome, from, to) ranges, inclusive; missing bounds are open, a reversed range is its start, adjacent ones join."""
    by: dict[str, list[tuple[int, int]]] = {}
    for chrom, lo, hi in ranges:
        lo, hi = 0 if lo is None else int(lo), MAX_POSITION if hi is None else int(hi)
        by.setdefault(str(chrom), []).append((lo, max(lo, hi)))
    out = []
    for chrom, each in by.items():
        each.sort()
        at = list(each[0])
        for lo, hi in each[1:]:
            if lo <= at[1] + 1:
                at[1] = max(at[1], hi)
            else:
                out.append((chrom, *at))
                at = [lo, hi]
        out.append((chrom, *at))
    return out


def by_chromosome(ds: VariantDataset, include: Iterable[str] | None = None, is_num: bool | None = None, from_bp: Sequence | None = None, to_bp: Sequence | None = None) -> VariantDataset:
    """Variants of chromosomes in a set and / or with a numeric name; with bounds, inside the union of the ranges."""
    numeric = F.col("chromosome").rlike(r"^\s*[+-]?[0-9]+$")
    if from_bp is not None or to_bp is not None:
        names = list(include or [])
        n = len(names)
        spread = lambda b: [None] * n if b is None else list(b) * (n if len(b) == 1 else 1)
        return by_ranges(ds, zip(names, spread(from_bp), spread(to_bp), strict=True), strip=None)
    test = None
    if include is not None:
        test = F.col("chromosome").isin([str(c) for c in include])
    if is_num is not None:
        n = numeric if is_num else ~numeric
        test = n if test is None else test | n
    return ds if test is None else ds.filtered(variants=ds.variants.where(test))


#: Ranges that are written into the plan as expressions; more are joined.
INLINE_RANGES = 64


def by_ranges(ds: VariantDataset, ranges: Iterable[tuple] | DataFrame, strip: str | None = "chr") -> VariantDataset:
    """Variants inside the union of (chromosome, from, to) ranges; ``strip`` is removed once from chromosome names."""
    if not isinstance(ranges, DataFrame):
        each = merged_ranges((str(c).replace(strip, "", 1) if strip else c, lo, hi) for c, lo, hi in ranges)
        if len(each) <= INLINE_RANGES:
            test = F.lit(False)
            for c, lo, hi in each:
                test = test | ((F.col("chromosome") == c) & F.col("position").between(lo, hi))
            return ds.filtered(variants=ds.variants.where(test))
        ranges = ds.spark.createDataFrame(each, "chromosome string, lo long, hi long")
    else:
        c, lo, hi = ranges.columns[:3]
        name = F.col(c).cast("string")
        name = F.when(F.instr(name, strip) > 0, F.concat(F.substring_index(name, strip, 1), F.expr(f"substring(`{c}`, instr(`{c}`, '{strip}') + {len(strip)})"))).otherwise(name) if strip else name
        lo = F.coalesce(F.col(lo).cast("long"), F.lit(0))
        ranges = ranges.select(name.alias("chromosome"), lo.alias("lo"), F.greatest(lo, F.coalesce(F.col(hi).cast("long"), F.lit(MAX_POSITION))).alias("hi"))
    return ds.filtered(variants=range_semi_join(ds.variants, ranges))


def range_semi_join(variants: DataFrame, ranges: DataFrame, bin_bits: int = 17) -> DataFrame:
    """variants with a position inside any range, as an equi join on (chromosome, bin).

    The union of the ranges is taken first by gaps and islands, so no variant meets two of them in a bin; a range
    that covers whole bins is one row per bin only up to the positions that a chromosome has.
    """
    ext = variants.groupBy("chromosome").agg(F.min("position").cast("long").alias("_min"), F.max("position").cast("long").alias("_max"))
    r = ranges.join(ext, "chromosome").select("chromosome", F.greatest("lo", "_min").alias("lo"), F.least("hi", "_max").alias("hi")).where("lo <= hi")
    w = Window.partitionBy("chromosome").orderBy("lo", "hi")
    r = r.withColumn("_top", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_i", F.sum(F.coalesce(F.col("lo") > F.col("_top") + 1, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    r = r.groupBy("chromosome", "_i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    r = r.select(F.col("chromosome").alias("_c"), "lo", "hi", F.explode(F.sequence(F.shiftright("lo", bin_bits), F.shiftright("hi", bin_bits))).alias("_bin"))
    on = (F.col("chromosome") == F.col("_c")) & (F.shiftright(F.col("position").cast("long"), bin_bits) == F.col("_bin")) & F.col("position").between(F.col("lo"), F.col("hi"))
    return variants.join(r, on, "left_semi")


def match_positions(variants: DataFrame, queries: DataFrame) -> DataFrame:
    """Left join of queries(query_ix, chromosome, position[, ref, alt]) to variants: (query_ix, variant_index).

    A null ref or alt matches anything; alt is compared to all after the first comma, and a variant without other alleles
    matches no alt that is given.
    """
    q = queries.select("query_ix", F.col("chromosome").cast("string").alias("_c"), F.col("position").cast("int").alias("_p"), *([F.col("ref").alias("_r"), F.col("alt").alias("_a")] if "ref" in queries.columns else [F.lit(None).cast("string").alias("_r"), F.lit(None).cast("string").alias("_a")]))
    a = F.col("allele")
    v = variants.select("variant_index", "chromosome", "position", C.ref(a).alias("_ref"), C.alt(a).alias("_alt"), a.contains(",").alias("_has"))
    on = (F.col("_c") == F.col("chromosome")) & (F.col("_p") == F.col("position"))
    on = on & (F.col("_r").isNull() | (F.col("_r") == F.col("_ref"))) & (F.col("_a").isNull() | (F.col("_has") & (F.col("_a") == F.col("_alt"))))
    return q.join(v, on, "left").select("query_ix", "variant_index")


def by_positions(ds: VariantDataset, queries: DataFrame, multi: bool = True) -> VariantDataset:
    """Variants that any query matches; with ``multi`` false, only the first match of each query."""
    if ("ref" in queries.columns) != ("alt" in queries.columns):
        raise ValueError("give both ref and alt, or neither")
    m = match_positions(ds.variants, queries).where("variant_index is not null")
    m = m.select("variant_index") if multi else m.groupBy("query_ix").agg(F.min("variant_index").alias("variant_index")).select("variant_index")
    return ds.filtered(variants=ds.variants.join(m.distinct(), "variant_index", "left_semi"))


def position_index(ds: VariantDataset, queries: DataFrame) -> DataFrame:
    """(query_ix, place): place of each query's first match among the selected variants by_positions() gives, or null."""
    m = match_positions(ds.variants, queries)
    first = m.groupBy("query_ix").agg(F.min("variant_index").alias("variant_index"))
    chosen = numbered(m.where("variant_index is not null").select("variant_index").distinct(), "variant_index")
    return first.join(chosen, "variant_index", "left").select("query_ix", F.col("_rank").cast("long").alias("place"))


def index_of_requested(ids: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """(request_ix, place) of requested ids(request_ix, key) in the selected rows chosen(key, index) in index order."""
    index = next(c for c in chosen.columns if c != key)
    return ids.join(numbered(chosen, index).select(key, "_rank"), key, "left").select("request_ix", F.col("_rank").alias("place"))


def condition(maf: Sequence | float | None = None, mac: Sequence | float | None = 1, missing_rate: float | None = None) -> Column:
    """mac1 <= MAC < mac2, maf1 <= MAF < maf2 and missing <= rate over counted variants; null is false."""
    test = F.lit(True)
    for bound, value in ((maf, S.frequency(minor=True)), (mac, S.count(minor=True))):
        lo, hi = (*bound, None)[:2] if isinstance(bound, (tuple, list)) else (bound, None)
        if lo is not None:
            test = test & (value >= lo)
        if hi is not None:
            test = test & (value < hi)
    if missing_rate is not None:
        test = test & (S.missing_rate() <= missing_rate)
    return F.coalesce(test, F.lit(False))


def by_condition(ds: VariantDataset, maf=None, mac=1, missing_rate=None, dense: bool = False) -> VariantDataset:
    """Variants of the selection by frequency, count and missing rate; the default drops those without variation."""
    n = (S.dense_counts if dense else S.counts)(ds).where(condition(maf, mac, missing_rate))
    return ds.filtered(variants=n.drop("n_total", "n_missing", "n_allele"))


def flags(full: VariantDataset, ds: VariantDataset, axis: str = "variant") -> DataFrame:
    """(index, selected) over the whole file."""
    key = f"{axis}_index"
    chosen = getattr(ds, f"{axis}s").select(key, F.lit(True).alias("_in"))
    return getattr(full, f"{axis}s").select(key).join(chosen, key, "left").select(key, F.coalesce("_in", F.lit(False)).alias("selected"))


def split(variants: DataFrame, parts: int | None = None, block: int | None = None) -> DataFrame:
    """variants with ``part``: equal parts (the i-th ends at round(i n / parts), half to even) or blocks of fixed size."""
    v = numbered(variants, "variant_index")
    if block:
        return v.withColumn("part", F.floor((F.col("_rank") - 1) / block).cast("int") + 1).drop("_rank")
    n = variants.count()
    ends = [round(i * n / parts) for i in range(1, parts + 1)]
    return v.withColumn("part", F.size(F.filter(F.lit(ends), lambda e: e < F.col("_rank"))) + 1).drop("_rank")
