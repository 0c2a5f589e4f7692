"""Operator 9: delta-maintained token counts.

Totals by source, language and tokenizer version are sums of signed rows: an
insert adds a document's counts, a delete takes them away, a revision takes the
old ones away and adds the new. A batch of changes is reduced to one row per key
(combined on the map side, so a hot source costs no more than a cold one) and
committed under its own name. Totals are read by adding up the committed batches;
they are additive, so neither order nor re-reading of texts matters.

Commits are idempotent: a batch is committed if and only if its folder holds the
writer's ``_SUCCESS`` file, which is made last. A batch that is committed already is
skipped, one that broke off half-way is written anew. ``compact`` folds committed
batches into one snapshot that keeps the names of what it holds, so a batch that
comes again later is still known.

Defined cases: null texts count no tokens, null sources and languages are keys of
their own; a document that is deleted without being known gives negative totals
(the log is a sum, and says so); a key whose documents and tokens are all zero is
not listed; an empty batch or table is committed and changes nothing; repeated rows
and equal ids count each time; texts of any length are encoded whole; other columns of
the input are not looked at.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialize, small, table

KEY = ["source", "lang", "tokenizer"]
SUMS = ["n_docs", "n_tokens", "n_chars"]
#: Where the vocabularies of public tokenizers are; a parameter, on every executor.
TOKENIZERS = "/opt/tokenizers"
BPE = "byte_bpe_50k"
#: Fixed value: the published splitting pattern of that vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_encodings: dict[str, object] = {}


def encoding(path: str):
    """The byte-level BPE in a file of ranks; made once a worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("rollup", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for batch in batches:
            words, bpe = [], []
            for x in batch.column("text"):
                t = x.as_py() or ""
                words.append(len(_WORDS.findall(t)))
                bpe.append(len(enc.encode_ordinary(t)))
            i = batch.schema.get_field_index("text")
            yield batch.remove_column(i).append_column("words", pa.array(words, pa.int64())).append_column("bpe", pa.array(bpe, pa.int64()))

    return run


def count_tokens(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, lang, digest, n_chars, words, bpe) of docs(doc_id, source, lang, text): counts of two tokenizers."""
    text = F.col("text").cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("digest"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), text.alias("text"))
    return d.mapInArrow(_counted(f"{tokenizers}/{BPE}.tiktoken"), "doc_id long, source string, lang string, digest string, n_chars long, words long, bpe long")


def signed(counts: DataFrame, sign: int | Column = 1) -> DataFrame:
    """The signed rows of counted documents, one per tokenizer version."""
    s = F.lit(sign) if isinstance(sign, int) else sign
    versions = F.explode(F.array(F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("n")), F.struct(F.lit(f"{BPE}-1").alias("tokenizer"), F.col("bpe").alias("n"))))
    c = counts.withColumn("_s", s.cast("long")).select("source", "lang", "n_chars", "_s", versions.alias("v"))
    return c.select("source", "lang", "v.tokenizer", F.col("_s").alias("n_docs"), (F.col("_s") * F.col("v.n")).alias("n_tokens"), (F.col("_s") * F.col("n_chars")).alias("n_chars"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The signed rows of documents that were counted as old and are counted as new now."""
    return signed(old, -1).unionByName(signed(new, 1))


class Rollup:
    """Totals under a path of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p) if self._done(f"{folder}/{x.getPath().getName()}")) if fs.exists(p) else []

    def _done(self, name: str) -> bool:
        fs, p = self._fs(f"{self.path}/{name}/_SUCCESS")
        return fs.exists(p)

    def _snapshot(self) -> str | None:
        """The newest complete snapshot; each holds all that the ones before it hold."""
        return max(self._names("snapshots"), default=None)

    def _snap(self) -> DataFrame | None:
        s = self._snapshot()
        return self.spark.read.parquet(f"{self.path}/snapshots/{s}") if s else None

    def known(self, batch: str) -> bool:
        """Whether a batch is committed, by a look at its folder or in the snapshot; no list of names is fetched."""
        if self._done(f"batches/{batch}"):
            return True
        snap = self._snap()
        return snap is not None and not snap.where(F.col("batch") == batch).isEmpty()

    def batches(self) -> list[str]:
        """Names of the committed batches, those in the snapshot among them."""
        snap = self._snap()
        held = [r["batch"] for r in snap.where("batch is not null").select("batch").collect()] if snap is not None else []
        return sorted({*held, *self._names("batches")})

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add signed rows under a name; False, without any change, if that name is committed already."""
        if not re.fullmatch(r"[A-Za-z0-9][-A-Za-z0-9.]*", batch):
            raise ValueError("a batch is named by letters, digits, '-' and '.'")
        if self.known(batch):
            return False
        rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]).write.mode("overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _rows(self, names: list[str]) -> DataFrame | None:
        """The rows of the snapshot and of those of the named batches that it does not hold."""
        snap, out = self._snap(), None
        if snap is not None:
            # Of the batches that are still listed, those the snapshot holds: it was made while a folder waited to be deleted.
            held = {r["batch"] for r in snap.where(F.col("batch").isin(names)).select("batch").collect()} if names else set()
            names = [n for n in names if n not in held]
            out = snap.where("batch is null").select(*KEY, *SUMS)
        if names:
            more = self.spark.read.parquet(*[f"{self.path}/batches/{b}" for b in names]).select(*KEY, *SUMS)
            out = more if out is None else out.unionByName(more)
        return out

    def totals(self, names: list[str] | None = None) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens, n_chars) over all committed batches, or the snapshot and the named ones."""
        rows = self._rows(self._names("batches") if names is None else names)
        if rows is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long, n_chars long")
        return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]).where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def compact(self) -> None:
        """Fold the batches that are committed now into a new snapshot, in which their names stay known.

        One list of batches is taken at the start; one that is committed meanwhile is neither counted nor deleted.
        """
        names, snap = self._names("batches"), self._snap()
        if not names:
            return
        s = self._snapshot()
        known = self.spark.createDataFrame([(n,) for n in names], "batch string")
        if snap is not None:
            known = known.unionByName(snap.where("batch is not null").select("batch")).distinct()
        new = self.totals(names).withColumn("batch", F.lit(None).cast("string")).unionByName(known, allowMissingColumns=True)
        new.write.mode("overwrite").parquet(f"{self.path}/snapshots/{int(s or 0) + 1:012d}")
        for n in names:
            fs, p = self._fs(f"{self.path}/batches/{n}")
            fs.delete(p, True)


def draft(docs: DataFrame) -> DataFrame:
    """docs as they were before their revision: without the last third of each text."""
    text = F.col("text").cast("string")
    return docs.withColumn("text", F.substring(text, F.lit(1), F.length(text) - F.floor(F.length(text) / 3).cast("int")))


def op9_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after these batches: drafts of all documents are inserted, all are revised to their full texts, exact copies are
    deleted, and the first two batches are sent again.

    Of documents with equal texts, those but the one of the least id are deleted by their own counts.
    """
    docs = table(spark, sf_dir, "documents")
    old = count_tokens(draft(docs))
    counts = materialize(count_tokens(docs), "rollup-counts")
    rollup = Rollup(spark, fresh_path(spark, "rollup"))
    drafts = materialize(signed(old).groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in SUMS]), "rollup-drafts")
    rollup.commit("insert-0", drafts)
    revision = signed(counts).unionByName(drafts.select(*KEY, *[(-F.col(c)).alias(c) for c in SUMS]))
    rollup.commit("revise-1", revision)
    same = counts.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    copies = counts.join(small(materialize(same, "rollup-same")), "digest").where(F.col("doc_id") > F.col("_first"))
    rollup.commit("delete-copies-2", signed(copies, -1))
    rollup.commit("insert-0", drafts)
    rollup.commit("revise-1", revision)
    return rollup.totals()
