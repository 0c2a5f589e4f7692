"""Operator 6: n-gram Jaccard self-join by prefix trees.

A document's set is its distinct word shingles as 64-bit hashes, kept in the one
global order of those hashes. Sets are joined by tries of ordered sets: a probe
walks a trie from the root, the overlap with a common beginning is counted once
for all sets below it, and a subtree is left as soon as the tokens that remain on
both sides cannot reach the threshold.

To distribute this, documents with equal sets become one class first. Two sets
with Jaccard >= t differ in at most k tokens, k depending on their size class only,
so of k + 2 segments of the global order at least two hold exactly the same tokens of
both. Classes that share such a segment are candidates. An empty segment says nothing
and makes no candidates: where one of two sets has one empty segment at most, they
share another. The few sets with several empty segments meet over the tokens of their
prefixes besides (the first n - ceil(t n) + 1 in the global order, of which a linking
pair has one in common). Below t = 8/9 segments get so short that unrelated sets with
a passage in common share them; there, BANDS bands of ROWS min-hashes take their
place. A pair at t = 0.8 shares none of them with probability (1 - 0.8^5)^60 < 5e-11,
less at higher similarity.

Candidates reached over one another form a block, and every block has its own trie. A
large block is cut into parts of about PART sets, and its links are found in rounds,
of which a task never holds more than two parts:

1. each part by itself;
2. again and again, as long as that halves the number of groups: a few sets of every
   linked group, dealt into parts anew. A dense group of copies is one group after
   this, in time in proportion to its size;
3. where several groups remain, all sets outside a block's largest group against all
   of the block, part by part.

No pair of sets in different groups is left out; pairs inside one group need no test.
A task reports a spanning forest of its links, and the components are joined up
afterwards.

Defined cases:

* null or blank text: the empty set, linked with nothing (its component is its own id);
* fewer words than the shingle size: the whole sequence is the one shingle;
* texts of any length are read whole (a text is worked on at once, in about 30 times its size);
* equal documents and ties: one class, represented by its least id; rows with one ``doc_id`` are one node of the graph;
* a null ``doc_id`` is linked with nothing and has a null component;
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkit
from .common import connected_components, materialize, small, table

#: Sets in a part of a block; a task joins two parts at most.
PART = 128
#: Sets of a group that stand for it in the second round.
STAND_INS = 4
#: Longest piece of a trie edge: bounds are tested after each.
EDGE = 48
#: Bands and min-hashes in each, where segments would be too short.
BANDS, ROWS = 60, 5
_U = np.uint64
_rng = np.random.default_rng(20240602)
_MUL, _ADD = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * _U(2) + _U(1), _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


class Classes:
    """Size classes for a threshold of num / den, and the segments of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den, self.top = num, den, [1 * den // num]

    def of(self, n: int) -> int:
        while self.top[-1] < n:
            self.top.append((self.top[-1] + 1) * self.den // self.num)
        return int(np.searchsorted(self.top, n))

    def segments(self, c: int) -> int:
        # Sizes n <= m, overlap o <= n and union u <= n den / num: the sets differ in u - o <= u (den - num) / den tokens.
        differ = self.top[c] * (self.den - self.num) // self.num
        return differ + 2 if differ else 1


def segment_signatures(s: np.ndarray, c: int, parts: int, prefix: int) -> np.ndarray:
    """One hash per segment of the sorted set s that is not empty: of the class, the segment and the tokens in it.

    With several empty segments, also one per token of the prefix.
    """
    with np.errstate(over="ignore"):
        at = ((s >> _U(32)) * _U(parts)) >> _U(32)
        edge = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(textkit.mix64(s ^ _U(0xA0761D6478BD642F)), out=total[1:])
        out = textkit.mix64(total[edge[1:]] - total[edge[:-1]] + textkit.mix64(np.arange(parts, dtype=np.uint64) + _U(c << 32)))
        full = edge[1:] > edge[:-1]
        if parts - int(full.sum()) < 2:
            return out[full]
        return np.concatenate([out[full], textkit.mix64(s[:prefix] ^ textkit.mix64(np.array([(c << 32) + (1 << 31)], np.uint64)))])


def band_signatures(s: np.ndarray) -> np.ndarray:
    """One hash per band of ROWS min-hashes of the set s."""
    with np.errstate(over="ignore"):
        low = np.concatenate([(s[None, :] * _MUL[i : i + ROWS, None] + _ADD[i : i + ROWS, None]).min(1) for i in range(0, BANDS * ROWS, ROWS)])
        out = np.arange(BANDS, dtype=np.uint64)
        for row in low.reshape(BANDS, ROWS).T:
            out = textkit.mix64(out * _U(0x2545F4914F6CDD1D) + row)
        return out


def signatures(s: np.ndarray, classes: Classes) -> np.ndarray:
    """What sets that may link share at least one of."""
    if not len(s):
        return np.zeros(0, np.uint64)
    if 9 * classes.num < 8 * classes.den:
        return band_signatures(s)
    c = classes.of(len(s))
    prefix = len(s) + classes.num * len(s) // -classes.den + 1
    return np.concatenate([segment_signatures(s, x, classes.segments(x), prefix) for x in {c, max(c - 1, 0)}])


def sets_of(text: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every row."""
    for lo, hi, data, off in textkit.slices(text):
        start, end, first = textkit.word_bounds(data, off)
        s, at = textkit.shingles(textkit.word_hashes(data, start, end), first, size)
        for r in range(hi - lo):
            yield lo + r, np.unique(s[at[r] : at[r + 1]])


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))


def _signed(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = Classes(num, den)
        for batch in batches:
            ids, sizes, h1, h2, sigs = batch.column("doc_id").to_pylist(), [], [], [], []
            done = 0

            def flush(upto: int):
                out = pa.RecordBatch.from_arrays([pa.array(ids[done:upto], pa.int64()), pa.array(sizes, pa.int64()), pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)), _lists(sigs)], ["doc_id", "n_shingles", "h1", "h2", "sigs"])
                for x in (sizes, h1, h2, sigs):
                    x.clear()
                return out

            held = 0
            for row, s in sets_of(batch.column("text"), size):
                sizes.append(len(s))
                with np.errstate(over="ignore"):
                    h1.append(np.sum(textkit.mix64(s), dtype=np.uint64))
                    h2.append(np.sum(textkit.mix64(s ^ _U(0xE7037ED1A0B428DB)), dtype=np.uint64))
                sigs.append(signatures(s, classes))
                held += len(sigs[-1])
                if held > 1_000_000:
                    yield flush(row + 1)
                    done, held = row + 1, 0
            yield flush(len(ids))

    return run


def _with_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(c) for c in ("key", "comp", "cells")]
            done, held, got = 0, 0, []
            for row, s in sets_of(batch.column("text"), size):
                got.append(s)
                held += len(s)
                if held > 1_000_000:
                    yield pa.RecordBatch.from_arrays([*(x.slice(done, row + 1 - done) for x in rest), _lists(got)], ["key", "comp", "cells", "set"])
                    done, held, got = row + 1, 0, []
            yield pa.RecordBatch.from_arrays([*(x.slice(done) for x in rest), _lists(got)], ["key", "comp", "cells", "set"])

    return run


class Trie:
    """A path-compressed trie of sorted sets as flat arrays, one row per edge piece.

    Rows are in breadth-first order, so the children of a row are neighbours.
    """

    def __init__(self, sets: list[np.ndarray], edge: int = EDGE):
        order = sorted(range(len(sets)), key=lambda i: sets[i].tolist())
        ranked = [sets[i] for i in order]
        same = [0]
        for a, b in zip(ranked, ranked[1:], strict=False):
            m = min(len(a), len(b))
            d = np.flatnonzero(a[:m] != b[:m])
            same.append(int(d[0]) if len(d) else m)
        size = np.array([len(s) for s in ranked])
        level = [(0, len(ranked), 0, 0)]
        tokens, cut, child, depth, least, most, leaf, who = [], [0], [], [], [], [], [], []
        root_children: list[int] | None = None
        while level:
            nxt, kids = [], []
            for lo, hi, d, row in level:
                # Sets lo..hi agree on d tokens; those that end here are answers of this row.
                first = len(child)
                i = lo
                while i < hi and size[i] == d:
                    if row >= 0 and d:
                        who.append((row, order[i]))
                    i += 1
                while i < hi:
                    j = i + 1
                    common = size[i]
                    while j < hi and same[j] > d:
                        common = min(common, same[j])
                        j += 1
                    end = min(int(common) if j > i + 1 else int(size[i]), d + edge)
                    tokens.append(ranked[i][d:end])
                    cut.append(cut[-1] + end - d)
                    child.append((0, 0))
                    depth.append(end)
                    least.append(int(size[i:j].min()))
                    most.append(int(size[i:j].max()))
                    nxt.append((i, j, end, len(child) - 1))
                    i = j
                kids.append((row, first, len(child)))
            for row, a, b in kids:
                if root_children is None:
                    root_children = [a, b]
                else:
                    child[row] = (a, b)
            level = nxt
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.cut, self.child, self.depth = np.array(cut), np.array(child, int).reshape(-1, 2), np.array(depth)
        self.least, self.most, self.root = np.array(least), np.array(most), root_children or [0, 0]
        self.ends: dict[int, list[int]] = {}
        for row, s in who:
            self.ends.setdefault(row, []).append(s)
        self.ends_at = np.zeros(len(child), bool)
        self.ends_at[list(self.ends)] = True

    def probe(self, x: np.ndarray, num: int, den: int) -> list[int]:
        """The sets s with den * |x & s| >= num * |x | s|."""
        n, found = len(x), []
        rows, before = np.arange(*self.root), np.zeros(self.root[1] - self.root[0], int)
        while len(rows):
            lo, hi = self.cut[rows], self.cut[rows + 1]
            count = hi - lo
            start = np.cumsum(count) - count
            at = np.repeat(lo - start, count) + np.arange(int(count.sum()))
            t = self.tokens[at]
            place = np.searchsorted(x, t)
            place[place == n] = n - 1
            over = before + np.add.reduceat((x[place] == t).astype(int), start)
            used = np.searchsorted(x, self.tokens[hi - 1], "right")
            # The most overlap that a set of size m below can reach is over + min(n - used, m - depth); the best m is tried.
            d = self.depth[rows]
            m = np.clip(n - used + d, self.least[rows], self.most[rows])
            reach = over + np.minimum(n - used, m - d)
            alive = den * reach >= num * (n + m - reach)
            rows, over = rows[alive], over[alive]
            for i in np.flatnonzero(self.ends_at[rows]):
                r, o = int(rows[i]), int(over[i])
                if den * o >= num * (n + int(self.depth[r]) - o):
                    found += self.ends[r]
            kids = self.child[rows]
            many = kids[:, 1] - kids[:, 0]
            before = np.repeat(over, many)
            begin = np.cumsum(many) - many
            rows = np.repeat(kids[:, 0] - begin, many) + np.arange(int(many.sum()))
        return found


def forest(keys: list[int], sets: list[np.ndarray], side: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links among the sets, within one side or between sides 0 and 1: every key with the least key that it is linked to.

    Sets with one key count as linked.
    """
    root: dict[int, int] = {k: k for k in keys}

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    two = 1 in side
    inside = [i for i, s in enumerate(side) if s == 0]
    trie = Trie([sets[i] for i in inside])
    for p in [i for i, s in enumerate(side) if s == 1] if two else inside:
        for q in trie.probe(sets[p], num, den):
            a, b = find(keys[p]), find(keys[inside[q]])
            root[max(a, b)] = min(a, b)
    return [(k, r) for k in root if (r := find(k)) != k]


def _joined(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keys, side, sets = None, [], [], []
        for batch in batches:
            k = list(zip(*(batch.column(c).to_pylist() for c in ("comp", "i", "j")), strict=True))
            own, sd = batch.column("key").to_pylist(), batch.column("side").to_pylist()
            col = batch.column("set")
            at, flat = col.offsets.to_numpy(), col.values.to_numpy().view(np.uint64)
            out: list[tuple[int, int]] = []
            for r in range(batch.num_rows):
                if k[r] != key:
                    out += forest(keys, sets, side, num, den) if len(keys) > 1 else []
                    key, keys, side, sets = k[r], [], [], []
                keys.append(own[r])
                side.append(sd[r])
                sets.append(flat[at[r] : at[r + 1]].copy())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])
        out = forest(keys, sets, side, num, den) if len(keys) > 1 else []
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return run


def _part(parts: str, seed: int, key: str = "cls") -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.col(parts)).cast("int")


def _cell(i: Column, j: Column, side: Column) -> Column:
    """A task of the join: the part whose trie is built (side 0) and the one that probes it (side 1), or one part alone."""
    return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))


def _join_cells(text: DataFrame, cells: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The links (a, b) of keys, each to the least key of its cell that it is linked to, found in the cells of (cls, key, comp, cells)."""
    sets = text.join(small(materialize(cells, "ngram-cells")), F.col("doc_id") == F.col("cls")).select("key", "comp", "cells", "text")
    sets = sets.mapInArrow(_with_sets(size), "key long, comp long, cells array<struct<i:int,j:int,side:int>>, set array<long>")
    dealt = sets.select("key", "comp", "set", F.explode("cells").alias("x")).select("key", "comp", "set", "x.i", "x.j", "x.side")
    n = int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["comp", "i", "j"]
    return materialize(dealt.repartition(n, *by).sortWithinPartitions(*by, "key").mapInArrow(_joined(num, den), "a long, b long"), "ngram-links")


def _regrouped(groups: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, comp, grp) with each group under the group that it was linked to; a group is in one cell, so it has one link at most."""
    return groups.join(small(links), F.col("grp") == F.col("a"), "left").select("cls", "comp", F.coalesce("b", "grp").alias("grp"))


def _between_parts(text: DataFrame, big: DataFrame, links: DataFrame, size: int, num: int, den: int, part: int) -> list[DataFrame]:
    """More links of the blocks with several parts (cls, comp), whose parts were joined by themselves with these links."""
    found, before, groups = [], None, big.withColumn("grp", F.col("cls"))
    while True:
        groups = materialize(_regrouped(groups, links), "ngram-groups")
        sizes = groups.groupBy("comp", "grp").agg(F.count(F.lit(1)).alias("n"))
        still = sizes.groupBy("comp").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("all"), F.max(F.struct("n", "grp")).alias("top")).where("groups > 1")
        still = materialize(still.select("comp", "groups", "all", F.col("top.n").alias("top"), F.col("top.grp").alias("top_grp")), "ngram-open")
        total, blocks = still.agg(F.sum("groups"), F.count(F.lit(1))).first()
        if not total:
            return found
        rest = groups.join(small(still, blocks), "comp")
        if before is not None and 2 * total > before:
            break
        before = total
        few = rest.groupBy("comp", "grp", "groups").agg(F.array_distinct(F.array(*[F.min(F.struct(F.xxhash64("cls", F.lit(k)), "cls")).getField("cls") for k in range(STAND_INS)])).alias("few"))
        few = few.select(F.explode("few").alias("cls"), F.col("grp").alias("key"), "comp", F.ceil(F.col("groups") * STAND_INS / part).cast("int").alias("parts"))
        # All that stand in for one group are in one cell.
        mine = _part("parts", 1 + len(found), "key")
        links = _join_cells(text, few.select("cls", "key", "comp", F.array(_cell(mine, mine, F.lit(0))).alias("cells")), size, num, den)
        found.append(links)
        groups = rest.select("cls", "comp", "grp")
    groups = rest
    # All others against the largest group (its parts are numbered after theirs) and against one another.
    others, largest = F.ceil((F.col("all") - F.col("top")) / part).cast("int"), F.ceil(F.col("top") / part).cast("int")
    groups = groups.select("cls", "comp", F.col("grp").alias("key"), (F.col("grp") == F.col("top_grp")).alias("in_top"), others.alias("others"), largest.alias("largest"))
    groups = groups.withColumn("p", F.when(F.col("in_top"), F.col("others") + _part("largest", 0)).otherwise(_part("others", 0)))
    probes = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: _cell(i, F.col("p"), F.lit(1)))
    among = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda q: _cell(F.least(q, F.col("p")), F.greatest(q, F.col("p")), q < F.col("p")))
    tries = F.transform(F.sequence(F.col("others"), F.col("others") + F.col("largest") - 1), lambda j: _cell(F.col("p"), j, F.lit(0)))
    cells = F.when(F.col("in_top"), probes).otherwise(F.concat(among, tries))
    return [*found, _join_cells(text, groups.select("cls", "key", "comp", cells.alias("cells")), size, num, den)]


def ngram_components(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id) for docs(doc_id, text): documents link when den * overlap >= num * union."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    a = materialize(text.mapInArrow(_signed(size, num, den), "doc_id long, n_shingles long, h1 long, h2 long, sigs array<long>"), "ngram-sigs")
    # Equal sets are one class, under its least id; only classes of several documents need a lookup.
    same = a.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("cls"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    same = materialize(same, "ngram-same")
    a = a.join(small(same), ["h1", "h2", "n_shingles"], "left").withColumn("cls", F.when(F.col("doc_id").isNotNull(), F.coalesce("cls", "doc_id")))
    # Star edges: every class with a signature to the least class with the same one.
    # Signatures are shuffled once, for their minima and for the join with those, which streams over them.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = a.where("doc_id = cls").select("cls", F.explode("sigs").alias("sig")).repartition(n, "sig")
    lead = sig.groupBy("sig").agg(F.min("cls").alias("lead"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    stars = sig.join(lead.hint("shuffle_hash"), "sig").where("cls <> lead").select("cls", "lead")
    blocks = connected_components(stars, "cls", "lead")
    blocks = materialize(blocks.unionByName(blocks.select(F.col("component").alias("node"), "component").distinct()), "ngram-blocks")
    members = materialize(blocks.groupBy("component").agg(F.count(F.lit(1)).alias("_n")).withColumn("parts", F.ceil(F.col("_n") / part).cast("int")).drop("_n"), "ngram-parts")
    cand = blocks.join(small(members), "component").select(F.col("node").alias("cls"), F.col("component").alias("comp"), "parts")
    cand = materialize(cand, "ngram-cand")
    edges = [_join_cells(text, cand.select("cls", F.col("cls").alias("key"), "comp", F.array(_cell(_part("parts", 0), _part("parts", 0), F.lit(0))).alias("cells")), size, num, den)]
    big = cand.where("parts > 1").drop("parts")
    if not big.isEmpty():
        edges += _between_parts(text, big, edges[0], size, num, den, part)
    edges = reduce(DataFrame.unionByName, edges)
    linked = materialize(connected_components(edges), "ngram-components").withColumnRenamed("node", "_node")
    out = a.select("doc_id", "n_shingles", "cls").join(small(linked), F.col("cls") == F.col("_node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "cls").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without near-duplicates: of each component the document of the least id stays, and every null id.

    Rows with one ``doc_id`` are one document, of which the least row (by all its columns) stays.
    """
    comp = ngram_components(docs.select("doc_id", "text"), size, num, den).where("doc_id = component_id")
    kept = materialize(comp.groupBy(F.col("doc_id").alias("__kept")).agg(F.count(F.lit(1)).alias("__rows")), "ngram-kept")
    d = docs.join(small(kept), F.col("doc_id") == F.col("__kept"))
    row = F.struct(*[F.col(c) for c in docs.columns])
    twice = d.where("__rows > 1").groupBy("__kept").agg(F.min(row).alias("__row")).select("__row.*")
    return d.where("__rows = 1").select(*docs.columns).unionByName(twice).unionByName(docs.where("doc_id is null"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under a Jaccard similarity of 0.9 of their 3-word shingles."""
    return ngram_components(table(spark, sf_dir, "documents"))


#: DuckDB's version of op6_ngram_join: every pair of documents that shares a shingle, then all that links reach.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), chr(32)) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
  l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * o >= 90 * (x.n + y.n - o)),
  e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
  r(doc_id, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.reach) AS component_id FROM d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
