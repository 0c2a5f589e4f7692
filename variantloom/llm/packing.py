"""Operator 4: conflict-constrained best-fit packing of documents into bins.

Documents become pieces of at most CAPACITY tokens (full pieces have a bin of
their own, as nothing fits beside them). Pieces are packed in shards, largest
first. Open bins are kept in order of residual capacity; each carries a bitmap of
the duplicate clusters in it and bitmaps of its sources, the n-th of which holds
the sources that are in it n times or more. A piece goes to the successor of its
size among the residuals, and the search goes on upwards until the tightest
compatible bin is found: no other piece of its cluster is in it, and fewer than
PER_SOURCE of its source. Without one, a new bin is opened.

A shard is a seeded share of about SHARD_ROWS documents, so a shard is one task's
bounded work whatever the sources and clusters are; a hot source, a large cluster
or a row that is there many times is spread over all shards by the hash of the row
and its number among its equals. No document is dropped or cut short: the pieces of
a document cover it whole.

Defined cases:

* null or blank text has size 0 and is one piece of size 0, which takes part like any other;
* a null source is a source of its own; documents with an empty cluster key conflict with nobody;
* equal or null ids and repeated rows are packed one by one; equal rows are one cluster;
* texts of any length are cut into pieces by their count of words alone;
* ties in size are broken by cluster, source, id; an empty table gives an empty result;
* other columns of the input are not looked at, but for ``cluster``, which is the cluster key where there is one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import expanded, materialize, table
from .mixing import word_count

#: Tokens of a bin, documents of a shard on average, and how often one source may be in a bin.
CAPACITY, SHARD_ROWS, PER_SOURCE = 4096, 2000, 3
SCHEMA = "doc_id long, piece int, pieces int, size long, source string, shard long, bin_id string, bin_offset long"


class Packer:
    """The open bins of one shard."""

    def __init__(self, capacity: int = CAPACITY, per_source: int = PER_SOURCE):
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []  # (residual, bin)
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self._bits: dict = {}

    def bit(self, kind: str, value) -> int:
        return 1 << self._bits.setdefault((kind, value), len(self._bits))

    def place(self, size: int, source, cluster) -> tuple[int, int]:
        """(bin, offset in it) of a piece."""
        s = self.bit("s", source)
        c = self.bit("c", cluster) if cluster is not None else 0
        i = bisect_left(self.order, (size, -1))
        while i < len(self.order):
            residual, b = self.order[i]
            if not self.clusters[b] & c and not self.sources[b][-1] & s:
                del self.order[i]
                break
            i += 1
        else:
            residual, b = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
        self.clusters[b] |= c
        levels = self.sources[b]
        levels[next(n for n, have in enumerate(levels) if not have & s)] |= s
        insort(self.order, (residual - size, b))
        return b, self.capacity - residual


def pack_shard(rows: list[tuple], capacity: int, per_source: int) -> Iterator[tuple]:
    """(row, piece, pieces, size, bin, offset) for rows of (doc_id, size, source, cluster)."""
    pieces = []
    for r, (_, size, _, _) in enumerate(rows):
        n = max(-(-size // capacity), 1)
        pieces += [(r, k, n, min(capacity, size - k * capacity)) for k in range(n)]
    known = lambda x: (x is None, x)
    key = lambda p: (-p[3], known(rows[p[0]][3]), known(rows[p[0]][2]), known(rows[p[0]][0]), p[1])
    packer = Packer(capacity, per_source)
    for r, k, n, size in sorted(pieces, key=key):
        _, _, source, cluster = rows[r]
        # Every piece carries the cluster. Pieces of one document are not kept apart by it: all but the last fill a bin each.
        b, offset = packer.place(size, source, cluster)
        yield r, k, n, size, b, offset


def _packed(capacity: int, per_source: int):
    def finish(shard: int, rows: list[tuple]) -> pa.RecordBatch:
        out = list(pack_shard(rows, capacity, per_source))
        col = lambda f, kind: pa.array([f(x) for x in out], kind)
        return pa.RecordBatch.from_arrays(
            [col(lambda x: rows[x[0]][0], pa.int64()), col(lambda x: x[1], pa.int32()), col(lambda x: x[2], pa.int32()), col(lambda x: x[3], pa.int64()), col(lambda x: rows[x[0]][2], pa.string()), pa.array([shard] * len(out), pa.int64()), col(lambda x: f"{shard}-{x[4]}", pa.string()), col(lambda x: x[5], pa.int64())],
            ["doc_id", "piece", "pieces", "size", "source", "shard", "bin_id", "bin_offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            for shard, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "size", "source", "cluster")), strict=True):
                if shard != at:
                    if rows:
                        yield finish(at, rows)
                    at, rows = shard, []
                rows.append(tuple(row))
        if rows:
            yield finish(at, rows)

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, per_source: int = PER_SOURCE, seed: int = 11) -> DataFrame:
    """Pieces and bins of docs(doc_id, text, source[, cluster]); bins are numbered within shards.

    Without a column ``cluster``, documents whose lower-cased words are equal are one cluster.
    """
    words = F.regexp_replace(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+", " ")
    cluster = F.col("cluster").cast("string") if "cluster" in docs.columns else F.when(F.trim(words) != "", F.md5(F.trim(words)))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"), F.col("source").cast("string").alias("source"), cluster.alias("cluster"))
    # Equal rows are counted and told apart by their number, so that they spread over the shards like any others.
    d = materialize(d.groupBy(*d.columns).agg(F.count(F.lit(1)).alias("_copies")), "pack")
    shards = max(1, -(-(d.agg(F.sum("_copies")).first()[0] or 0) // shard_rows))
    d = expanded(d, "_copies").withColumn("shard", F.pmod(F.xxhash64("doc_id", "size", "cluster", F.lit(seed), "_copy"), F.lit(shards)))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.repartition(max(n, min(shards, 100_000)), "shard").sortWithinPartitions("shard").mapInArrow(_packed(capacity, per_source), SCHEMA)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all documents."""
    return pack(table(spark, sf_dir, "documents"))
