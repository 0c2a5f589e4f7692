"""VCF text to typed columns and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import columns as C

_TYPES = {"Integer": "int", "Float": "double", "String": "string", "Character": "string", "Flag": "boolean"}


def spark_type(vcf_type: str) -> str:
    return _TYPES[vcf_type]


def value(text: Column, vcf_type: str, strict: bool = False) -> Column:
    """One value: '.' is null ('' for text); other text that is no number is null, or an error if strict."""
    t = F.trim(text)
    if vcf_type in ("String", "Character"):
        return F.when(t == ".", "").otherwise(t)
    kind = _TYPES[vcf_type]
    return F.when((t == ".") | (t == ""), F.lit(None).cast(kind)).otherwise(t.cast(kind) if strict else t.try_cast(kind))


def values(text: Column, vcf_type: str, strict: bool = False) -> Column:
    """A comma-separated list of values; null stays null."""
    return F.transform(F.split(text, ","), lambda x: value(x, vcf_type, strict))


def expected(number: str, n_allele: Column) -> Column | None:
    """How many values a Number stands for: A, R, G (always the diploid count) or a constant; None for '.'."""
    if number == "A":
        return n_allele - 1
    if number == "R":
        return n_allele
    if number == "G":
        return (n_allele * (n_allele + 1) / 2).cast("int")
    return None if number == "." else F.lit(int(number))


def sized(array: Column, number: str, n_allele: Column, name: str, kind: str, strict: bool = True) -> Column:
    """Check a list against its Number: too many values are an error (cut off if not strict), too few are filled with nulls.

    A missing list has no values if its length may vary, and only nulls if it is fixed.
    """
    n = expected(number, n_allele)
    if n is None:
        return F.coalesce(array, F.array().cast(f"array<{kind}>"))
    full = F.concat(F.slice(array, F.lit(1), F.greatest(n, F.lit(0))), F.array_repeat(F.lit(None).cast(kind), F.greatest(n - F.size(array), F.lit(0))))
    if strict:
        full = F.when(F.size(array) > n, F.raise_error(F.concat(F.lit(f"{name} has more values than Number={number}: "), F.array_join(array.cast("array<string>"), ",", "."))).cast(f"array<{kind}>")).otherwise(full)
    none = F.array().cast(f"array<{kind}>") if number in "ARG" else F.array_repeat(F.lit(None).cast(kind), n)
    return F.when(array.isNull(), none).otherwise(full)


def info_text(info: Column, name: str) -> Column:
    """Text of an INFO key: the first of repeated ones counts, null without it, '' for a bare flag."""
    hit = F.filter(F.split(info, ";"), lambda e: (e == name) | e.startswith(name + "="))
    first = F.get(hit, F.lit(0))
    return F.when(first.isNotNull(), F.substring(first, F.lit(len(name) + 2), F.length(first)))


def strip_prefix(chromosome: Column, prefixes: tuple[str, ...] = ("chr",)) -> Column:
    """Without the first matching prefix, in either case."""
    out = chromosome
    done = F.lit(False)
    for p in prefixes:
        hit = F.lower(F.substring(chromosome, 1, len(p))) == p.lower()
        out = F.when(hit & ~done, F.substring(chromosome, F.lit(len(p) + 1), F.length(chromosome))).otherwise(out)
        done = done | hit
    return out


def alleles_of(gt: Column, n_allele: Column | None = None, strict: bool = False) -> Column:
    """Allele codes of a GT text; '.' is null.

    With the number of alleles, a code at or over it is null as well. With ``strict``, such a code, and a text that is no
    code, is an error.
    """

    def one(x: Column) -> Column:
        code = F.trim(x).try_cast("int")
        beyond = F.lit(False) if n_allele is None else (code >= n_allele) | (code < 0)
        if not strict:
            return F.when(~beyond, code) if n_allele is not None else code
        wrong = (code.isNull() & ~F.trim(x).isin(".", "")) | F.coalesce(beyond, F.lit(False))
        return F.when(wrong, F.raise_error(F.concat(F.lit("no allele of this variant: "), gt)).cast("int")).otherwise(code)

    return F.transform(F.split(gt, r"[|/]"), one)


def padded(codes: Column, ploidy: int) -> Column:
    return F.slice(F.concat(codes, F.array_repeat(F.lit(None).cast("int"), ploidy)), 1, ploidy)


def general(x: Column) -> Column:
    """A number with six significant digits, without trailing zeros, as C's %g prints it; null is '.'.

    Ties are judged by the shortest decimal form of the number, so the last digit may differ from C's where that form ends
    in a 5 and the binary number lies a little off it.
    """
    size = F.abs(x)
    e = F.floor(F.log10(F.format_string("%.5e", size).cast("double")))
    plain = F.lit(None).cast("string")
    for k in range(-4, 6):
        # Ties go to the even digit; the formatting functions would round them up.
        digits = F.bround(x.try_cast("decimal(38,20)"), 5 - k).cast("string")
        plain = F.when(e == k, F.regexp_replace(digits, r"\.?0+$", "") if 5 - k > 0 else digits).otherwise(plain)
    sci = F.format_string("%.5e", x)
    sci = F.concat(F.regexp_replace(F.substring_index(sci, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(sci, "e", -1))
    special = F.when(F.isnan(x), "nan").when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
    return F.when(x.isNull(), ".").when(special.isNotNull(), special).when(x == 0, "0").when((e >= -4) & (e < 6), plain).otherwise(sci)


def text_of(x: Column, kind: str) -> Column:
    """One value as VCF text: null and '' are '.'."""
    if kind in ("double", "float"):
        return general(x.cast("double"))
    return F.coalesce(F.nullif(x.cast("string"), F.lit("")), F.lit("."))


def list_text(a: Column, kind: str) -> Column:
    """A list as text: missing values at its end are left off, others are '.'; null if nothing is left."""
    t = F.transform(a, lambda x: text_of(x, kind))
    last = F.array_max(F.transform(t, lambda x, i: F.when(x != ".", i + 1).otherwise(0)))
    return F.when(last > 0, F.array_join(F.slice(t, F.lit(1), last), ","))


def info_entry(name: str, x: Column, spark_kind: str) -> Column:
    """NAME=value, NAME for a flag that is true, null if there is nothing to say."""
    if spark_kind == "boolean":
        return F.when(x, name)
    t = list_text(x, spark_kind[6:-1]) if spark_kind.startswith("array<") else F.nullif(text_of(x, spark_kind), F.lit("."))
    return F.when(t.isNotNull(), F.concat(F.lit(f"{name}="), t))


def head_columns(prefix: str = "") -> list[Column]:
    """CHROM to FILTER of a row."""
    a = F.col("allele")
    return [F.concat(F.lit(prefix), "chromosome"), F.col("position").cast("string"), F.coalesce(F.nullif(F.col("id"), F.lit("")), F.lit(".")), F.coalesce(F.nullif(C.ref(a), F.lit("")), F.lit(".")), F.coalesce(F.nullif(C.alt(a), F.lit("")), F.lit(".")), general(F.col("qual").cast("double")), F.coalesce("filter", F.lit("."))]
