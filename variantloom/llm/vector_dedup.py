"""Operator 7: near-duplicate vectors by iterative quantisation.

A rotation that makes the signs of the coordinates balanced, low-error binary
codes is learned on a bounded sample (ITQ, Gong and Lazebnik 2011: principal
directions, then alternating signs and an orthogonal Procrustes step). Every
vector gets TABLES chunks of BITS code bits, from as many such rotations as that
takes; vectors of one label that agree on a chunk meet in that bucket of the
multi-index Hamming tables. The tables hold ids and codes: of a bucket, those stay that
have another within the Hamming distance that pairs at the threshold keep to but for
six standard deviations. Only these are joined with the original vectors and reranked,
bucket by bucket, by cosine in double precision. Each pair is counted in the first
table it meets in.

Number and width of the chunks follow from the number of vectors of the largest
label, the threshold and the sample: a chunk has about log2(n) - 4 bits (8 at least), so
buckets stay as large as they are however many vectors there are, and there are enough chunks that a pair at the threshold is missed with probability MISS at
most, in the mean over the sample. Bits differ with probability angle / pi each, where
the angle is that of the pair as seen from the mean. Where that takes over WIDEN times
the chunks of a mean of zero, signs are taken without the mean, at the raw angle.

A bucket over PART vectors is cut into parts by hash, and each pair of parts is
compared by itself: no task holds more than two parts, none emits pairs. It
reports per vector the number of links, and a spanning forest of them.

Defined cases:

* a null label, a null vector, a zero vector, null or non-finite components: no links, its own component;
* vectors of other than the usual length are compared with those of their own length only (by zero links across);
* equal vectors are linked like any others; rows with one ``vec_id`` are one node, and a null ``vec_id`` takes no part
  (null component, kept);
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, materialize, small, table

#: Least cosine of a link; vectors that rotations are learned on, at most; chance that a pair at the threshold is missed.
COSINE, FIT_ROWS, MISS = 0.93, 8000, 0.01
#: Vectors in a part of a bucket.
PART = 128
ROUNDS = 30
#: Chunks for the angles about the mean, at most, as a multiple of those for the raw angle.
WIDEN = 8


def table_shape(n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(chunks, bits in each) for n vectors."""
    bits = max(8, math.ceil(math.log2(max(n, 2))) - 4)
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return math.ceil(math.log(miss) / math.log(1 - meet)), bits


def centred_shape(x: np.ndarray, n: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int, bool]:
    """(chunks, bits in each, whether the mean is taken off) for n vectors like the unit vectors x.

    Two vectors at the threshold are sqrt(2 - 2 cosine) apart, whatever is taken off both; at a distance r from the mean
    that is an angle of 2 asin(gap / 2 r).
    """
    chunks, bits = table_shape(n, cosine, miss)
    if len(x) < 2:
        return chunks, bits, True
    r = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
    half = np.minimum(math.sqrt(max(2 - 2 * cosine, 0)) / 2 / np.maximum(r, 1e-12), 1)
    meet = (1 - 2 * np.arcsin(half) / math.pi) ** bits
    for c in range(chunks, WIDEN * chunks + 1):
        if ((1 - meet) ** c).mean() <= miss:
            return c, bits, True
    return chunks, bits, False


def fit_itq(x: np.ndarray, rotations: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projections): of unit vectors x, ``rotations`` learned square projections side by side."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dim)
    values, vectors = np.linalg.eigh(np.cov((x - mean).T) + 1e-9 * np.eye(dim)) if len(x) > 1 else (np.ones(dim), np.eye(dim))
    v = (x - mean) @ vectors
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
        for _ in range(ROUNDS if len(x) > 1 else 0):
            b = np.where(v @ r >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        out.append(vectors @ r)
    return mean, np.hstack(out)


def hamming_limit(x: np.ndarray, total: int, centred: bool, cosine: float = COSINE) -> int:
    """Differing bits of ``total`` that a pair at the threshold stays within: by the angle that all but one in a thousand
    of the sample have at most, and six standard deviations."""
    p = math.acos(cosine) / math.pi
    if centred and len(x) > 1:
        r = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
        half = np.minimum(math.sqrt(max(2 - 2 * cosine, 0)) / 2 / np.maximum(r, 1e-12), 1)
        p = float(np.quantile(2 * np.arcsin(half) / math.pi, 0.999))
    return min(total, math.ceil(total * p + 6 * math.sqrt(total * p * (1 - p))))


def _unit(col: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of that length with a direction, their vectors in double precision)."""
    if not len(col):
        return np.zeros(0, int), np.zeros((0, dim))
    off, values = col.offsets.to_numpy(zero_copy_only=False), col.values
    nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    rows = np.flatnonzero(col.is_valid().to_numpy(zero_copy_only=False) & (np.diff(off) == dim) & (nulls[off[1:]] == nulls[off[:-1]]))
    x = values.to_numpy(zero_copy_only=False).astype(float)[off[rows][:, None] + np.arange(dim)]
    with np.errstate(over="ignore", invalid="ignore"):
        n = np.sqrt((x * x).sum(1))
    good = np.isfinite(n) & (n > 0)
    return rows[good], x[good]


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, chunks: int, bits: int) -> np.ndarray:
    """The chunks of each vector of x as integers."""
    u = x / np.sqrt((x * x).sum(1))[:, None]
    b = ((u - mean) @ projection[:, : chunks * bits] >= 0).reshape(len(x), chunks, bits)
    return b @ (1 << np.arange(bits)).astype(np.int64)


def _coded(dim: int, mean: np.ndarray, projection: np.ndarray, chunks: int, bits: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _unit(batch.column("embedding"), dim)
            if len(rows):
                c = codes(x, mean, projection, chunks, bits)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), chunks).cast(pa.list_(pa.int64()))
                wide = np.zeros((len(x), -(-chunks * bits // 64) * 64), np.uint8)
                wide[:, : chunks * bits] = (c[:, :, None] >> np.arange(bits) & 1).reshape(len(x), -1)
                packed = np.packbits(wide, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), batch.column("label").take(pa.array(rows)), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()), lists, pa.array([v.tobytes() for v in packed], pa.binary())], ["vec_id", "label", "vec", "code", "packed"])

    return run


def near_rows(key: np.ndarray, side: np.ndarray, within: np.ndarray, code: np.ndarray, limit: int) -> np.ndarray:
    """Which rows, sorted by key, have another of their key (of the other side, unless ``within``) at most ``limit`` bits away."""
    out, s = np.zeros(len(key), bool), 1
    while s < len(key):
        same = key[s:] == key[:-s]
        if not same.any():
            break
        a = np.flatnonzero(same & (within[s:] | (side[s:] != side[:-s])))
        hit = a[np.bitwise_count(code[a] ^ code[a + s]).sum(1) <= limit]
        out[hit] = out[hit + s] = True
        s += 1
    return out


def _near(limit: int):
    """Memberships of buckets whose vector has another near it there, from rows sorted by cell."""

    def kept(t: pa.Table) -> pa.RecordBatch:
        b = t.combine_chunks().to_batches()[0]
        raw = b.column("packed")
        first = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        code = np.frombuffer(raw.buffers()[2], np.uint8)[first[0] : first[-1]].reshape(len(raw), -1).copy().view(np.uint64)
        cell, side, i, j = (b.column(c).to_numpy() for c in ("cell", "side", "i", "j"))
        return b.filter(pa.array(near_rows(cell, side, i == j, code, limit))).select(["vec_id", "label", "chunk", "bucket"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t])
            cell = t.column("cell").to_numpy()
            # The last cell may go on in the next batch.
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
            if cut:
                yield kept(t.slice(0, cut))
            held = t.slice(cut)
        if held is not None and held.num_rows:
            yield kept(held)

    return run


def _dealt(members: DataFrame, part: int, name: str) -> DataFrame:
    """Memberships (vec_id, label, chunk, bucket, ...) of buckets of several, dealt to the pairs of their parts (i, j, side)."""
    key = ["label", "chunk", "bucket"]
    full = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / part).cast("int")).drop("n")
    met = members.join(small(materialize(full, name)), key).withColumn("p", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(F.least(q, F.col("p")).alias("i"), F.greatest(q, F.col("p")).alias("j"), (q < F.col("p")).cast("int").alias("side")))
    return met.withColumn("x", F.explode(pairs)).select(*members.columns, "x.i", "x.j", "x.side")


def compare(ids: np.ndarray, side: np.ndarray, x: np.ndarray, code: np.ndarray, chunk: int, cosine: float, within: bool = True) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(links of each row, spanning forest) among rows of one bucket: within side 0, or between sides 0 and 1."""
    u = x / np.sqrt((x * x).sum(1))[:, None]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    b = a if within else b
    hit = (u[a] @ u[b].T >= cosine) & (ids[a][:, None] != ids[b][None, :])
    for t in range(chunk):
        hit &= code[a, t][:, None] != code[b, t][None, :]
    links = np.zeros(len(ids), np.int64)
    links[a] += hit.sum(1)
    if not within:
        links[b] += hit.sum(0)
    root, forest = list(range(len(ids))), []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(hit), strict=True):
        p, q = find(int(a[i])), find(int(b[j]))
        if p != q:
            root[p] = q
            forest.append((int(ids[a[i]]), int(ids[b[j]])))
    return links, forest


def _compared(cosine: float, kind: str):
    cols = ["vec_id", "n_links", "other"]

    def finish(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        ids, side = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows])
        links, forest = compare(ids, side, np.array([np.frombuffer(r[2], kind) for r in rows]).astype(float), np.array([r[3] for r in rows]), key[1], cosine, key[3] == key[4])
        some = np.flatnonzero(links)
        a = [*ids[some].tolist(), *(x for x, _ in forest)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array([*links[some].tolist(), *([0] * len(forest))], pa.int64()), pa.array([*([None] * len(some)), *(y for _, y in forest)], pa.int64())], cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("label", "chunk", "bucket", "i", "j")), strict=True)
            for key, *row in zip(keys, *(batch.column(c).to_pylist() for c in ("vec_id", "side", "vec", "code")), strict=True):
                if key != at:
                    if len(rows) > 1:
                        yield finish(at, rows)
                    at, rows = key, []
                rows.append(tuple(row))
        if len(rows) > 1:
            yield finish(at, rows)

    return run


def vector_components(vectors: DataFrame, cosine: float = COSINE, miss: float = MISS, part: int = PART, fit_rows: int = FIT_ROWS, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for vectors(vec_id, embedding, label)."""
    # Components travel as they are stored; all arithmetic is in double precision.
    kind = "float32" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = v.where("vec_id is not null and label is not null and embedding is not null")
    lengths = usable.groupBy(F.size("embedding").alias("dim"), "label").count().groupBy("dim").agg(F.max("count").alias("n")).where("dim > 0").collect()
    found = None
    for row in lengths:
        dim = row["dim"]
        mine = usable.where(F.size("embedding") == dim)
        sample = mine.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(fit_rows).select("embedding").toArrow()
        _, x = _unit(sample.column("embedding").combine_chunks(), dim)
        x = x / np.sqrt((x * x).sum(1))[:, None] if len(x) else x
        chunks, bits, centred = centred_shape(x, row["n"], cosine, miss)
        mean, projection = fit_itq(x, -(-chunks * bits // dim), seed)
        mean = mean if centred else np.zeros(dim)
        coded = materialize(mine.select("vec_id", "embedding", "label").mapInArrow(_coded(dim, mean, projection, chunks, bits, kind), "vec_id long, label string, vec binary, code array<long>, packed binary"), "itq-codes")
        n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # First ids and codes alone; a cell's hash may be that of another, which only makes more candidates.
        tables = _dealt(coded.select("vec_id", "label", "packed", F.posexplode("code").alias("chunk", "bucket")), part, "itq-buckets")
        tables = tables.withColumn("cell", F.xxhash64("label", "chunk", "bucket", "i", "j"))
        limit = hamming_limit(x, chunks * bits, centred, cosine)
        near = tables.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_near(limit), "vec_id long, label string, chunk int, bucket long").distinct()
        near = materialize(near, "itq-near")
        who = near.select("vec_id").distinct()
        vecs = coded.select("vec_id", "label", "vec", "code").join(small(materialize(who, "itq-who")), "vec_id")
        met = _dealt(near, part, "itq-cells").join(vecs.withColumnRenamed("label", "_label"), "vec_id").where(F.col("label") == F.col("_label")).drop("_label")
        key = ["label", "chunk", "bucket", "i", "j"]
        # Rows of one id may have several vectors of a label: those stay that are in the bucket.
        met = met.where(F.get("code", F.col("chunk")) == F.col("bucket"))
        got = met.repartition(n, *key).sortWithinPartitions(*key).mapInArrow(_compared(cosine, kind), "vec_id long, n_links long, other long")
        found = got if found is None else found.unionByName(got)
    if found is None:
        return v.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialize(found, "itq-links")
    links = materialize(found.where("other is null").groupBy("vec_id").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("vec_id", "_id"), "itq-degrees")
    comp = connected_components(found.where("other is not null"), "vec_id", "other").withColumnRenamed("node", "_node")
    out = v.select("vec_id").join(small(links), F.col("vec_id") == F.col("_id"), "left").join(small(comp), F.col("vec_id") == F.col("_node"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all vectors of the embeddings table, within labels."""
    return vector_components(table(spark, sf_dir, "embeddings"))


#: DuckDB's version of op7_vectors, by comparing all pairs of a label.
SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {COSINE}),
  r(vec_id, reach) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.reach),
  c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id),
  k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN k ON k.a = c.vec_id"""
