"""Merging datasets by variants or by samples, and renumbering."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import columns as C
from ..session import tasks
from .filters import numbered

_CALL = ["variant_index", "sample_index", "a1", "a2", "phase", "dp", "ds"]


def sample_union(parts: list[VariantDataset]) -> DataFrame:
    """(sample_id, sample_index, files): samples of all files, those of the first first, each once."""
    each = [p.samples.select("sample_id", F.lit(i).alias("_f"), F.col("sample_index").alias("_i")) for i, p in enumerate(parts)]
    u = reduce(DataFrame.unionByName, each).groupBy("sample_id").agg(F.min(F.struct("_f", "_i")).alias("k"), F.count(F.lit(1)).alias("files"))
    return u.select("sample_id", F.row_number().over(Window.orderBy("k")).cast("int").alias("sample_index"), "files")


def merged_alleles(lists: Column) -> Column:
    """Distinct alleles of an array of allele strings, in order of first appearance, as one string."""
    return F.array_join(F.array_distinct(F.flatten(F.transform(lists, lambda a: F.split(a, ",")))), ",")


def remap(code: Column, local: Column, merged: Column) -> Column:
    """Allele code of a file's own alleles as a code of the merged ones; null stays null."""
    own = F.get(F.split(local, ","), code)
    return F.nullif(F.array_position(F.split(merged, ","), own), F.lit(0)).cast("int") - 1


def merge(*parts: VariantDataset) -> VariantDataset:
    """Merge by variants if the files share samples, otherwise by samples; sharing both is an error."""
    ids = sample_union(list(parts))
    shared = not ids.where("files > 1").isEmpty()
    return merge_variants(*parts) if shared or all(p.samples.isEmpty() for p in parts) else merge_samples(*parts)


def _tasks(parts: Sequence[VariantDataset], gaps: int = 0) -> int:
    """Tasks of a wide step over the recorded calls of the files (counted once where files share them) and so many gaps."""
    return tasks(parts[0].spark, sum(c.count() for c in {id(p.calls): p.calls for p in parts}.values()) + gaps)


def _moved(p: VariantDataset, places: DataFrame, own: DataFrame, n: int) -> DataFrame:
    """Recorded calls at their new places (variant_index -> _new, sample_index -> _s), which select them too; n tasks take them by variant."""
    c = p.calls.repartition(n, "variant_index").join(places, "variant_index")
    if p.n_samples > 500_000:
        return c.repartition(n, "sample_index").join(own, "sample_index")
    return c.join(F.broadcast(own), "sample_index")


def merge_variants(*parts: VariantDataset) -> VariantDataset:
    """Variants of the files one after the other; a sample that a file does not have is missing there.

    Variants are numbered anew in file order. A key that several files hold is an error.
    """
    if len({p.ploidy for p in parts}) > 1:
        raise ValueError("files differ in ploidy")
    if any(p.calls is None or "g" in p.calls.columns for p in parts):
        return _merge_variants_of_arrays([p.dense() for p in parts])
    keys = reduce(DataFrame.unionAll, [p.variants.select(C.chrom_pos_allele(F.col("chromosome"), F.col("position"), F.col("allele")).alias("k"), F.lit(i).alias("f")).distinct() for i, p in enumerate(parts)])
    if not keys.groupBy("k").count().where("count > 1").isEmpty():
        raise ValueError("files share both samples and variants")
    samples = sample_union(list(parts)).drop("files")
    absent = [samples.join(p.samples.select("sample_id"), "sample_id", "left_anti") for p in parts]
    n_absent = [a.count() for a in absent]
    n = _tasks(parts, sum(k * p.n_variants for k, p in zip(n_absent, parts, strict=True)))
    offset, variants, calls = 0, [], []
    for p, none_here, k in zip(parts, absent, n_absent, strict=True):
        # Places of a file's variants among its own, then moved behind those of the files before it.
        v = numbered(p.variants, "variant_index").withColumn("_new", (F.col("_rank") + offset).cast("int"))
        places = v.select("variant_index", "_new")
        variants.append(v.drop("_rank", "gt", "phase", "dp", "ds").withColumn("variant_index", F.col("_new")).drop("_new").withColumn("variant_id", F.col("variant_index").cast("long")))
        own = p.samples.select("sample_index", "sample_id").join(samples.withColumnRenamed("sample_index", "_s"), "sample_id").select("sample_index", "_s")
        have = _moved(p, places, own, n)
        calls.append(have.select(F.col("_new").alias("variant_index"), F.col("_s").cast("int").alias("sample_index"), *_CALL[2:]))
        if k:
            gap = places.crossJoin(none_here.select("sample_index"))
            none = {"a1": "int", "a2": "int", "dp": "int", "ds": "double"}
            calls.append(gap.select(F.col("_new").alias("variant_index"), "sample_index", *[(F.lit(False) if c == "phase" else F.lit(None).cast(none[c])).alias(c) for c in _CALL[2:]]))
        offset += p.n_variants
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), variants)
    annotation = _first_annotation(parts)
    merged = reduce(DataFrame.unionByName, calls).repartition(n, "variant_index")
    return VariantDataset(table, samples.join(annotation, "sample_id", "left"), merged, merge_meta(*parts), parts[0].ploidy)


def _array_columns(p: VariantDataset) -> list[str]:
    """Columns with a value a sample (gt: ploidy values): genotypes, phase, dosages, depths and FORMAT fields."""
    return [f.name for f in p.variants.schema.fields if f.dataType.typeName() == "array" and (f.name in ("gt", "phase", "dp", "ds") or f.name.startswith("fmt_"))]


def _kinds(parts: list[VariantDataset]) -> dict[str, str]:
    """The array columns of all files and their types; files have to agree on these."""
    out: dict[str, str] = {}
    for p in parts:
        for c in _array_columns(p):
            kind = p.variants.schema[c].dataType.simpleString()
            if out.setdefault(c, kind) != kind:
                raise ValueError(f"files differ in the type of {c}")
    return out


def _laid_out(column: str, kind: str, order: Column, ploidy: int) -> Column:
    """An array column with its values at the places that ``order`` names (0: none, so missing and not phased)."""
    none = F.lit(False) if column == "phase" else F.lit(None).cast(kind[6:-1])
    if column == "gt":
        return F.flatten(F.transform(order, lambda i: F.when((i > 0) & (F.size("gt") > 0), F.slice("gt", (i - 1) * ploidy + 1, ploidy)).otherwise(F.array_repeat(none, ploidy))))
    # A field that a variant does not have stays null.
    return F.when(F.col(column).isNotNull(), F.transform(order, lambda i: F.when(i > 0, F.coalesce(F.get(F.col(column), i - 1), none)).otherwise(none)))


def _placed_samples(parts: list[VariantDataset]) -> tuple[DataFrame, list[DataFrame]]:
    """The union of the samples, and per file one row: the place of every sample of the union among the file's own, or 0."""
    samples = sample_union(parts).drop("files")
    rows = []
    for p in parts:
        own = p.samples.select("sample_id", F.row_number().over(Window.orderBy("sample_index")).alias("_own"))
        have = samples.join(own, "sample_id", "left").select("sample_index", F.coalesce("_own", F.lit(0)).alias("_own"))
        rows.append(have.agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_index", "_own"))), lambda x: x["_own"]).alias("_order")))
    return samples, rows


def _with_annotation(samples: DataFrame, parts: list[VariantDataset]) -> DataFrame:
    return samples.join(_first_annotation(parts), "sample_id", "left")


def _merge_variants_of_arrays(parts: list[VariantDataset]) -> VariantDataset:
    """merge_variants() over arrays, of any ploidy: every array is laid out anew over the samples of all files, without a shuffle."""
    keys = reduce(DataFrame.unionAll, [p.variants.select(C.chrom_pos_allele(F.col("chromosome"), F.col("position"), F.col("allele")).alias("k"), F.lit(i).alias("f")).distinct() for i, p in enumerate(parts)])
    if not keys.groupBy("k").count().where("count > 1").isEmpty():
        raise ValueError("files share both samples and variants")
    kinds, p0 = _kinds(parts), parts[0].ploidy
    samples, orders = _placed_samples(parts)
    offset, variants = 0, []
    for p, order in zip(parts, orders, strict=True):
        v = numbered(p.variants.drop("gs", "geno_extra"), "variant_index").crossJoin(F.broadcast(order))
        v = v.withColumns({c: _laid_out(c, kinds[c], F.col("_order"), p0) for c in _array_columns(p)})
        v = v.withColumn("variant_index", (F.col("_rank") + offset).cast("int")).withColumn("variant_id", F.col("variant_index").cast("long")).drop("_rank", "_order")
        variants.append(v)
        offset += p.n_variants
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), variants)
    return VariantDataset(table, _with_annotation(samples, parts), None, merge_meta(*parts), p0)


def _merge_samples_of_arrays(parts: list[VariantDataset]) -> VariantDataset:
    """merge_samples() over arrays, of any ploidy: per variant, the files' arrays are put together in the order of all samples.

    A FORMAT field is null for a variant that has it in no file, and missing for the samples of files without it.
    """
    key, kinds, p0 = ["chromosome", "position", "allele"], _kinds(parts), parts[0].ploidy
    samples, orders = _placed_samples(parts)
    arrays = sorted(kinds)
    each = []
    for i, p in enumerate(parts):
        v = p.variants.drop("gs", "geno_extra", "variant_id")
        v = v.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("variant_index")))
        own = F.struct(*[F.col(c) if c in v.columns else F.lit(None).cast(kinds[c]).alias(c) for c in arrays]).alias("_own")
        rest = [c for c in v.columns if c not in (*key, *arrays, "_n", "variant_index")]
        each.append(v.select(*key, "_n", F.lit(i).alias("_f"), "variant_index", own, *rest))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    rest = [c for c in u.columns if c not in (*key, "_f", "_n", "variant_index", "_own")]
    first = u.groupBy(*key, "_n").agg(F.min(F.struct("_f", "variant_index")).alias("_k"), F.map_from_entries(F.collect_list(F.struct("_f", "_own"))).alias("_files"), *[F.min_by(c, "_f").alias(c) for c in rest])
    placed = numbered(first.withColumn("_file", F.col("_k._f")).withColumn("_old", F.col("_k.variant_index")), "_old", "_file")
    table = placed.withColumn("variant_index", F.col("_rank").cast("int")).withColumn("variant_id", F.col("_rank")).drop("_file", "_old", "_rank", "_k", "_n")
    # One row: of every sample of the union, its file and its place there.
    where = reduce(DataFrame.crossJoin, [o.withColumnRenamed("_order", f"_o{i}") for i, o in enumerate(orders)])

    def at(i: int) -> Column:
        return F.transform(F.col(f"_o{i}"), lambda x: F.when(x > 0, F.struct(F.lit(i).alias("f"), x.cast("int").alias("i"))))

    table = table.crossJoin(F.broadcast(where.select(reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), [at(i) for i in range(len(parts))]).alias("_where"))))

    def together(c: str) -> Column:
        none = F.lit(False) if c == "phase" else F.lit(None).cast(kinds[c][6:-1])
        of = lambda w: F.try_element_at("_files", w["f"])[c]
        if c == "gt":
            return F.flatten(F.transform("_where", lambda w: F.when(F.size(of(w)) > 0, F.slice(of(w), (w["i"] - 1) * p0 + 1, p0)).otherwise(F.array_repeat(none, p0))))
        out = F.transform("_where", lambda w: F.coalesce(F.get(of(w), w["i"] - 1), none))
        return out if c == "phase" else F.when(F.exists(F.map_values("_files"), lambda x: x[c].isNotNull()), out)

    table = table.withColumns({c: together(c) for c in arrays}).drop("_files", "_where")
    return VariantDataset(table, _with_annotation(samples, parts), None, merge_meta(*parts), p0)


def _first_annotation(parts) -> DataFrame:
    """Sample annotation of the first file that has the sample."""
    each = [p.samples.drop("sample_index").withColumn("_f", F.lit(i)) for i, p in enumerate(parts)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    cols = [c for c in u.columns if c not in ("sample_id", "_f")]
    return u.groupBy("sample_id").agg(*[F.min_by(c, "_f").alias(c) for c in cols]) if cols else u.select("sample_id").distinct()


def merge_samples(*parts: VariantDataset) -> VariantDataset:
    """Samples of the files side by side; variants are joined by chromosome, position and alleles.

    Order: the first file's variants, then each next file's new ones. A variant that a file does not have is missing for
    its samples. id, qual, filter and further columns are those of the first file that has the variant.
    """
    if len({p.ploidy for p in parts}) > 1:
        raise ValueError("files differ in ploidy")
    if any(p.calls is None or "g" in p.calls.columns for p in parts):
        return _merge_samples_of_arrays([p.dense() for p in parts])
    key = ["chromosome", "position", "allele"]
    samples = sample_union(list(parts)).drop("files")
    each = [p.variants.drop("gt", "phase", "dp", "ds", "variant_id").withColumn("_f", F.lit(i)) for i, p in enumerate(parts)]
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    # Repeats of a key within a file stay apart.
    u = u.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_f").orderBy("variant_index")))
    cols = [c for c in u.columns if c not in (*key, "_f", "_n", "variant_index")]
    first = u.groupBy(*key, "_n").agg(F.min(F.struct("_f", "variant_index")).alias("_k"), F.collect_set("_f").alias("_files"), *[F.min_by(c, "_f").alias(c) for c in cols])
    placed = numbered(first.withColumn("_file", F.col("_k._f")).withColumn("_old", F.col("_k.variant_index")), "_old", "_file")
    table = placed.withColumn("variant_index", F.col("_rank").cast("int")).withColumn("variant_id", F.col("_rank")).drop("_file", "_old", "_rank")
    n_all, calls = table.count(), []
    n = _tasks(parts, sum((n_all - p.n_variants) * p.n_samples for p in parts))
    for i, p in enumerate(parts):
        own = p.samples.select("sample_index", "sample_id").join(samples.withColumnRenamed("sample_index", "_s"), "sample_id").select("sample_index", "_s")
        places = u.where(F.col("_f") == i).select(*key, "_n", "variant_index").join(table.select(*key, "_n", F.col("variant_index").alias("_new")), [*key, "_n"]).select("variant_index", "_new")
        c = _moved(p, places, own, n)
        calls.append(c.select(F.col("_new").alias("variant_index"), F.col("_s").cast("int").alias("sample_index"), *_CALL[2:]))
        absent = table.where(~F.array_contains("_files", i)).select("variant_index").crossJoin(own.select(F.col("_s").cast("int").alias("sample_index")))
        calls.append(absent.select("variant_index", "sample_index", F.lit(None).cast("int").alias("a1"), F.lit(None).cast("int").alias("a2"), F.lit(False).alias("phase"), F.lit(None).cast("int").alias("dp"), F.lit(None).cast("double").alias("ds")))
    return VariantDataset(table.drop("_k", "_files", "_n"), samples.join(_first_annotation(parts), "sample_id", "left"), reduce(DataFrame.unionByName, calls).repartition(n, "variant_index"), merge_meta(*parts), parts[0].ploidy)


def merge_meta(*parts: VariantDataset) -> dict:
    """Distinct values of each name over the files; a name with one value keeps it plain, digests are left out."""
    out: dict = {}
    for p in parts:
        for k, v in p.meta.items():
            if k not in ("md5", "digest", "variants_filtered", "samples_filtered"):
                have = out.setdefault(k, [])
                have += [x for x in (v if isinstance(v, list) else [v]) if x not in have]
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def reset_variant_ids(parts: list[VariantDataset], start: int = 1, change: list[bool] | None = None) -> list[VariantDataset]:
    """Consecutive variant ids over files; a file that is not changed keeps its own but still takes up its range."""
    out = []
    for p, yes in zip(parts, change or [True] * len(parts), strict=True):
        v = numbered(p.variants, "variant_index").withColumn("variant_id", F.col("_rank") + (start - 1)).drop("_rank") if yes else p.variants
        out.append(p.with_(variants=v))
        start += p.n_variants
    return out
