"""VCF files: header, reader and writer."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..dataset import VariantDataset
from ..functions import vcf_text as T
from ..operators.summary import vcf_type
from ..session import ship

_FIELDS = re.compile(r'([A-Za-z0-9_]+)=("(?:[^"\\]|\\.)*"|[^,]*)(?:,|$)')


@dataclass
class Header:
    version: str = ""
    info: dict[str, dict] = field(default_factory=dict)
    format: dict[str, dict] = field(default_factory=dict)
    filter: dict[str, dict] = field(default_factory=dict)
    alt: dict[str, dict] = field(default_factory=dict)
    contig: dict[str, dict] = field(default_factory=dict)
    assembly: list[str] = field(default_factory=list)
    reference: list[str] = field(default_factory=list)
    other: list[tuple[str, str]] = field(default_factory=list)
    samples: list[str] = field(default_factory=list)
    ploidy: int = 2


def parse_header(lines: list[str], first_row: str | None = None) -> Header:
    """A header from its lines; VCF 4.0 or later is asked for, repeated lines count once."""
    h = Header()
    for line in dict.fromkeys(lines):
        if line.startswith("#CHROM"):
            h.samples = line.rstrip("\r\n").split("\t")[9:]
            continue
        key, _, text = line.rstrip("\r\n").lstrip("#").partition("=")
        if key == "fileformat":
            m = re.fullmatch(r"VCFv(\d+)\.(\d+)", text.strip())
            if not m or int(m[1]) < 4:
                raise ValueError(f"not a VCF file of version 4 or later: {text}")
            h.version = text.strip()
        elif text.startswith("<") and key.lower() in ("info", "format", "filter", "alt", "contig"):
            entry = {k: v[1:-1] if v.startswith('"') else v for k, v in _FIELDS.findall(text.strip()[1:-1])}
            if "ID" in entry:
                getattr(h, key.lower()).setdefault(entry["ID"], entry)
        elif key in ("assembly", "reference"):
            getattr(h, key).append(text)
        else:
            h.other.append((key, text))
    if not h.version:
        raise ValueError("no fileformat line")
    if first_row is not None:
        h.ploidy = infer_ploidy(first_row)
    return h


def infer_ploidy(row: str) -> int:
    """From the first row: the most alleles of a sample; if over 2, 2 where at least half of the samples have no more, else rounded up to even."""
    cells = row.split("\t")
    if len(cells) < 10 or not cells[8].split(":")[0] == "GT":
        return 2
    n = [len(re.split(r"[|/]", c.split(":")[0])) for c in cells[9:] if "," not in c.split(":")[0]]
    top = max(n, default=2)
    if top <= 2:
        return 2
    return 2 if sum(x <= 2 for x in n) * 2 >= len(n) else top + top % 2


def read_header(spark: SparkSession, path: str) -> Header:
    """Header lines and one row; the lines before #CHROM are few and come to the driver."""
    lines = spark.read.text(path)
    head = [r[0] for r in lines.where(F.col("value").startswith("#")).collect()]
    first = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).head()
    return parse_header(head, first[0] if first else None)


def sample_ids(spark: SparkSession, path: str) -> list[str]:
    return read_header(spark, path).samples


def count_rows(spark: SparkSession, *paths: str) -> int:
    return spark.read.text(list(paths)).where(~F.col("value").startswith("#") & (F.trim("value") != "")).count()


def numbered_lines(spark: SparkSession, paths: list[str], comment: str | None = "#") -> DataFrame:
    """(line_ix, value) of the data lines of files in order.

    Lines are numbered inside each split of a file, where one task reads them in order: their numbers in the scan, less
    the first of the split, plus the lines of the splits before. Only these two numbers a split are gathered; the text is
    not shuffled. ``line_ix`` starts at 1.
    """
    keep = F.trim("value") != ""
    if comment:
        keep = keep & ~F.col("value").startswith(comment)
    out = None
    for i, p in enumerate(paths):
        t = spark.read.text(p).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at")).where(keep)
        t = t.withColumn("_in", F.monotonically_increasing_id()).withColumn("_f", F.lit(i))
        out = t if out is None else out.unionByName(t)
    split = ["_f", "_file", "_at"]
    before = out.groupBy(*split).agg(F.count(F.lit(1)).alias("_n"), F.min("_in").alias("_first"))
    before = before.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = out.join(F.broadcast(before) if before.count() <= 500_000 else before, split)
    return ranked.select((F.col("_before") + F.col("_in") - F.col("_first") + 1).alias("line_ix"), "value")


def read_vcf(spark: SparkSession, *paths: str, info: list[str] | None = None, fmt: list[str] | None = None, ploidy: int | None = None, prefixes: tuple[str, ...] = ("chr",), start: int = 1, count: int = -1, strict: bool = True) -> VariantDataset:
    """Read files of the same samples, one after the other; gzip files are read whole, others in splits.

    ``info`` and ``fmt`` name the fields to take (all by default); start and count choose rows. Unknown INFO keys are
    passed over. With ``strict``, malformed numbers, lists longer than their Number and allele codes that the variant does
    not have are errors, else missing. A variant whose only allele is '.' has as many alleles as its genotypes say.

    A field is the column of its name, a FORMAT field with ``fmt_`` before it; names that differ from one that is there by
    case only get ``info_`` or an underscore more, and dots become underscores. ``meta["vcf"]["columns"]`` has the field of every such column.
    """
    ship(spark)
    heads = [read_header(spark, p) for p in paths]
    h = heads[0]
    if any(x.samples != h.samples for x in heads):
        raise ValueError("files differ in samples")
    p = ploidy or h.ploidy
    rows = numbered_lines(spark, list(paths))
    if start > 1 or count >= 0:
        rows = rows.where(F.col("line_ix").between(start, start + count - 1 if count >= 0 else 2**62)).withColumn("line_ix", F.col("line_ix") - (start - 1))
    c = F.split("value", "\t")
    at = lambda i: F.get(c, F.lit(i))
    alt = at(4)
    v = rows.select(
        F.col("line_ix").cast("int").alias("variant_index"), F.col("line_ix").alias("variant_id"), T.strip_prefix(at(0), prefixes).alias("chromosome"), at(1).cast("int").alias("position"),
        F.when((alt == ".") | (alt == ""), at(3)).otherwise(F.concat(at(3), F.lit(","), alt)).alias("allele"), F.when(at(2) == ".", "").otherwise(at(2)).alias("id"),
        T.value(at(5), "Float", strict).alias("qual"), F.when(at(6) == ".", F.lit(None)).otherwise(at(6)).alias("filter"), at(7).alias("_info"), at(8).alias("_format"), F.slice(c, 10, max(len(h.samples), 1)).alias("_cells"),
    )
    n = F.when(F.col("allele") == "", 0).otherwise(F.size(F.split("allele", ",")))
    cols, fields = {}, {}
    taken = {c.lower() for c in (*v.columns, "gt", "gs", "phase", "geno_extra", "num_allele")}

    def column(name: str, field: str, prefix: str = "") -> str:
        name = re.sub(r"\W", "_", name)
        if name.lower() in taken:
            name = prefix + name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        fields[name] = field
        return name

    for field, e in h.info.items():
        if info is not None and field not in info:
            continue
        name, key = column(field, field, "info_"), field
        t, number = T.info_text(F.col("_info"), key), e.get("Number", ".")
        if e.get("Type") == "Flag":
            cols[name] = t.isNotNull()
        elif number == "1":
            cols[name] = F.coalesce(T.value(t, e["Type"], strict), F.lit("")) if e["Type"] in ("String", "Character") else T.value(t, e["Type"], strict)
        else:
            cols[name] = T.sized(T.values(t, e["Type"], strict), number, n, name, T.spark_type(e["Type"]), strict)
    keys = F.split("_format", ":")
    for name, e in h.format.items():
        if name == "GT" or fmt is not None and name not in fmt:
            continue
        cols[column(f"fmt_{name}", name)] = _field(keys, name, lambda text, kind=e["Type"]: T.values(text, kind, strict))
    if h.samples:
        cols["_gt"] = F.coalesce(_field(keys, "GT", lambda text: text), F.transform("_cells", lambda _: F.lit(None).cast("string")))
    v = v.withColumns(cols)
    if h.samples:
        none = F.array_repeat(F.lit(None).cast("int"), p)
        known = F.when(F.col("allele").isin(".", ".,.", ""), F.lit(2**31 - 1)).otherwise(n)
        v = v.withColumn("_codes", F.transform("_gt", lambda g: T.alleles_of(g, known, strict)))
        rest = lambda codes: F.slice(codes, F.lit(p + 1), F.greatest(F.size(codes) - p, F.lit(0)))
        long = F.filter(F.transform("_codes", lambda codes, i: F.struct((i + 1).alias("sample_index"), rest(codes).alias("alleles"))), lambda x: F.size(x["alleles"]) > 0)
        most = F.greatest(F.coalesce(F.array_max(F.flatten("_codes")), F.lit(0)), F.lit(0)) + 1
        v = v.withColumns({"num_allele": F.when(F.col("allele").isin(".", ".,."), most).otherwise(n), "gt": F.flatten(F.transform("_codes", lambda codes: F.coalesce(T.padded(codes, p), none))), "phase": F.transform("_gt", lambda g: F.coalesce(g.contains("|"), F.lit(False))), "geno_extra": long})
    v = v.drop("_info", "_format", "_cells", "_gt", "_codes")
    s = spark.createDataFrame(list(enumerate(h.samples, 1)), "sample_index int, sample_id string")
    meta = {"file_format": "variantloom", "version": "1", "vcf": {"version": h.version, "info": h.info, "format": h.format, "filter": h.filter, "alt": h.alt, "contig": h.contig, "reference": h.reference, "columns": {c: f for c, f in fields.items() if c not in (f, f"fmt_{f}")}}}
    return VariantDataset(v, s, None, meta, p)


def _field(keys: Column, name: str, f) -> Column:
    """f of each sample's text of a FORMAT field; null where the row does not have the field."""
    k = F.array_position(keys, name)
    return F.when(k > 0, F.transform("_cells", lambda cell: f(F.get(F.split(cell, ":"), (k - 1).cast("int")))))


def header_lines(ds: VariantDataset, info: list[str], fmt: list[str]) -> list[str]:
    h = ds.meta.get("vcf", {})
    kind = {f.name: f.dataType.simpleString() for f in ds.variants.schema.fields}
    quoted = lambda e: ",".join(f'{k}="{v}"' if k in ("Description", "Source", "Version") else f"{k}={v}" for k, v in e.items())
    field = lambda n: h.get("columns", {}).get(n, n.upper() if n in ("dp", "ds") else n.removeprefix("fmt_"))
    guess = lambda n: {"ID": n, "Number": "0" if kind[n] == "boolean" else "." if kind[n].startswith("array") else "1", "Type": vcf_type(kind[n]), "Description": n}
    out = ["##fileformat=VCFv4.2", "##source=variantloom", *[f"##reference={r}" for r in h.get("reference", [])]]
    out += [f"##INFO=<{quoted(h.get('info', {}).get(field(n)) or {**guess(n), 'ID': field(n)})}>" for n in info]
    out += [f"##FILTER=<{quoted(e)}>" for e in h.get("filter", {}).values()]
    out += ['##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">'] if "gt" in kind else []
    out += [f"##FORMAT=<{quoted(h.get('format', {}).get(field(n)) or {**guess(n), 'ID': field(n)})}>" for n in fmt]
    return out + [f"##contig=<{quoted(e)}>" for e in h.get("contig", {}).values()] + [f"##ALT=<{quoted(e)}>" for e in h.get("alt", {}).values()]


def vcf_lines(ds: VariantDataset, info: list[str] | None = None, fmt: list[str] | None = None, prefix: str = "") -> DataFrame:
    """(variant_index, value): one line of VCF text per variant of the selection."""
    v = ds.dense().variants if ds.calls is not None else ds.variants
    fixed = {"variant_index", "variant_id", "chromosome", "position", "allele", "id", "qual", "filter", "gt", "phase", "dp", "ds", "geno_extra", "num_allele", "p_partkey"}
    kind = {f.name: f.dataType.simpleString() for f in v.schema.fields}
    info = [c for c in kind if c not in fixed and not c.startswith("fmt_")] if info is None else info
    fmt = [c for c in kind if c.startswith("fmt_") or c in ("dp", "ds")] if fmt is None else fmt
    if missing := [n for n in (*info, *fmt) if n not in kind]:
        raise KeyError(f"no such field: {', '.join(missing)}")
    field = lambda n: ds.meta.get("vcf", {}).get("columns", {}).get(n, n.removeprefix("fmt_"))
    entries = F.array_compact(F.array(*[T.info_entry(field(n), F.col(n), kind[n]) for n in info])) if info else F.array().cast("array<string>")
    cells = [*T.head_columns(prefix), F.coalesce(F.nullif(F.array_join(entries, ";"), F.lit("")), F.lit("."))]
    if "gt" in kind:
        from ..functions.columns import gt_text

        names = [n.upper() if n in ("dp", "ds") else field(n) for n in fmt]
        # A field that the variant does not have is left out of its FORMAT.
        have = [F.exists(F.col(n), lambda x: x.isNotNull()) for n in fmt]
        cells.append(F.concat_ws(":", F.lit("GT"), *[F.when(F.coalesce(y, F.lit(False)), n) for y, n in zip(have, names, strict=True)]))

        def one(n: str):
            inner = kind[n][6:-1]
            return F.transform(F.col(n), lambda x: F.coalesce(T.list_text(x, inner[6:-1]), F.lit(".")) if inner.startswith("array<") else T.text_of(x, inner))

        texts = [F.when(F.coalesce(y, F.lit(False)), one(n)) for y, n in zip(have, fmt, strict=True)]
        v = v.withColumn("_g", gt_text(F.col("gt"), F.col("phase"), ds.ploidy)).withColumns({f"_t{i}": t for i, t in enumerate(texts)})
        v = v.withColumn("_cells", F.transform("_g", lambda g, i: F.concat_ws(":", g, *[F.get(F.col(f"_t{k}"), i) for k in range(len(texts))])))
        cells.append(F.array_join("_cells", "\t"))
    return v.select("variant_index", F.concat_ws("\t", *cells).alias("value"))


#: Bytes of text in a block of BGZF, at most.
BGZF_BYTES = 65_280


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """A gzip member with the extra field that gives its length, as blocks of BGZF have it; empty data make the end mark."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0"
    return head + struct.pack("<H", len(head) + len(body) + 9) + body + struct.pack("<II", zlib.crc32(data), len(data))


def _bgzf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines to blocks without their last byte, which is zero in every block: its trailer ends with a length below 65,536."""
    held = bytearray()
    for batch in batches:
        out = []
        for x in batch.column(0):
            held += x.as_py().encode() + b"\n"
            while len(held) >= BGZF_BYTES:
                out.append(bgzf_block(bytes(held[:BGZF_BYTES]))[:-1])
                del held[:BGZF_BYTES]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([bgzf_block(bytes(held))[:-1]], pa.binary())], ["block"])


def write_vcf(ds: VariantDataset, path: str, info: list[str] | None = None, fmt: list[str] | None = None, prefix: str = "", header: bool = True, compression: str | None = None) -> None:
    """Write the selection as a folder of VCF text whose parts, in order of their names, are one file; the header comes first.

    ``compression`` is a codec of Spark's, or "bgzf": blocks that BGZF readers take, the parts as one file again.
    """
    lines = vcf_lines(ds, info, fmt, prefix)
    if header:
        kind = ds.dense().variants.columns if ds.calls is not None else ds.variants.columns
        fixed = {"variant_index", "variant_id", "chromosome", "position", "allele", "id", "qual", "filter", "gt", "phase", "dp", "ds", "geno_extra", "num_allele", "p_partkey"}
        dense = ds.dense() if ds.calls is not None else ds
        top = header_lines(dense, [c for c in kind if c not in fixed and not c.startswith("fmt_")] if info is None else info, [c for c in kind if c.startswith("fmt_") or c in ("dp", "ds")] if fmt is None else fmt)
        ids = [r["sample_id"] for r in ds.samples.orderBy("sample_index").select("sample_id").collect()] if "gt" in kind else []
        names = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *ids] if ids else [])]
        lines = ds.spark.createDataFrame([(i - len(top) - 1, x) for i, x in enumerate([*top, "\t".join(names)])], "variant_index int, value string").unionByName(lines)
    lines = lines.orderBy("variant_index").select("value")
    if compression == "bgzf":
        blocks = lines.mapInArrow(_bgzf, "block binary").select(F.col("block").cast("string").alias("block"))
        end = ds.spark.createDataFrame([(bytearray(bgzf_block(b"")[:-1]),)], "block binary").select(F.col("block").cast("string").alias("block"))
        blocks.unionByName(end).write.mode("overwrite").option("lineSep", "\x00").text(path)
        return
    w = lines.write.mode("overwrite")
    (w.option("compression", compression) if compression else w).text(path)
