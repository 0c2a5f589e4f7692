"""The pipeline stage by stage against brute force, and the registered queries with SQL."""

import hashlib
import os
import re
import sys
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from compare import duck_rows, same, spark_rows
from test_operators import ROWS, SCHEMA, brute_base, brute_quotients, brute_random, brute_score, components, shingles

import corpus_pipeline
from variantloom.llm import mixing, packing, quality, secrets
from variantloom.llm.common import table
from variantloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, duck, name):
    cols, rows = spark_rows(QUERIES[name](spark, SF))
    want_cols, want = duck_rows(duck, ORACLE_SQL[name])
    assert cols == want_cols and same(rows, want)


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def brute(spark, docs):
    """What each stage keeps, computed on the driver one document at a time."""
    out = []
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = []
    for r in docs:
        (_, _, x, at), = quality.bags(pa.array([r[1]], pa.string()))
        if model.score(x, at)[0] >= quality.KEEP:
            kept.append(r)
    out.append(kept)
    comp = components({r[0]: shingles(r[1], 5) for r in kept}, 80, 100)
    kept = [r for r in kept if comp[r[0]] == r[0]]
    out.append(kept)
    kept = [(i, t := secrets.redact(x, secrets.scan(x)[1]), lang, s, len(t)) for i, x, lang, s, _ in kept]
    out.append(kept)
    return out


def test_stages(spark):
    docs = [tuple(r[c] for c in COLUMNS) for r in table(spark, SF, "documents").collect()]
    want = brute(spark, docs)
    cur = table(spark, SF, "documents")
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:3], want, strict=False):
        got = stage(spark, cur, SF)
        assert got.columns == COLUMNS
        assert rows_of(got) == sorted(expected, key=repr), name
        cur = spark.createDataFrame(expected, table(spark, SF, "documents").schema)
    assert [len(w) for w in want] != [len(docs)] * 3 and any("[SECRET]" in r[1] for r in want[2])
    # Mixing: every document floor(taken / size + 1/2) times, and sources near their targets.
    mixed = {r["doc_id"]: r for r in mixing.mix(cur).collect()}
    got = corpus_pipeline.mixing_sources(spark, cur, SF)
    times = Counter(r["doc_id"] for r in got.collect())
    assert got.columns == COLUMNS and times == Counter({i: n for i, r in mixed.items() if r["size"] and (n := int(r["taken"] / r["size"] + 0.5))})
    words, target = defaultdict(int), {}
    for i, r in mixed.items():
        words[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(words[s] - t) <= 3 * mixing.BLOCK_TOKENS for s, t in target.items())
    # Packing: all pieces are there, bins hold what they may.
    rows = got.collect()
    bins = defaultdict(list)
    sizes = Counter()
    for r in corpus_pipeline.best_fit_packing(spark, spark.createDataFrame(rows, got.schema), SF).collect():
        bins[r["bin_id"]].append(r)
        sizes[r["doc_id"]] += r["size"]
    need = Counter()
    for r in rows:
        need[r["doc_id"]] += len(WORDS.findall(r["text"]))
    assert sizes == need
    for b in bins.values():
        assert sum(r["size"] for r in b) <= packing.CAPACITY and max(Counter(r["source"] for r in b).values()) <= packing.PER_SOURCE
        assert max(Counter(r["doc_id"] for r in b if r["pieces"] == 1).values(), default=1) == 1


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert set(got.columns) >= {"doc_id", "bin_id", "bin_offset"} and got.count() > 100


def brute_mix(docs):
    """How often each document is taken, by the words of the contract: targets by lifting sources over their cap one by one,
    blocks to the highest quotients one by one, and each source's (one shard's) stream walked document by document."""
    size = {r[0]: len(WORDS.findall(r[1] or "")) for r in docs}
    total = defaultdict(int)
    for r in docs:
        total[r[3]] += size[r[0]]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(total.values()))
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * total[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * total[s]
            left -= target[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    block = max(1, min(mixing.BLOCK_TOKENS, int(min(target[s] for s in names if total[s]) // mixing.LEAST_BLOCKS)))
    quota = dict(zip(names, brute_quotients([target[s] for s in names], round(sum(total.values()) / block)), strict=True))
    times = {}
    for s in names:
        mine = sorted((r for r in docs if r[3] == s), key=lambda r: hashlib.md5(f"{mixing.SEED}:{r[0]}".encode()).hexdigest())
        assert len(mine) <= mixing.SHARD_ROWS
        left = min(quota[s] * block, 3 * total[s])
        passes = min(left // max(total[s], 1), 3)
        left -= passes * total[s]
        for r in mine:
            got = min(left, size[r[0]])
            left -= got
            taken = passes * size[r[0]] + got
            if size[r[0]] and (n := int(taken / size[r[0]] + 0.5)):
                times[r[0]] = n
    return times, size


def test_run_against_brute_force(spark):
    """The rows of run() from scorer, scanner, redaction, mixing and packing rules that are written a second time in tests."""
    docs = [tuple(r[c] for c in COLUMNS) for r in table(spark, SF, "documents").collect()]
    model = quality.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    kept = [r for r in docs if brute_score(model, r[1]) >= 0.3]
    comp = components({r[0]: shingles(r[1], 5) for r in kept}, 80, 100)
    kept = [r for r in kept if comp[r[0]] == r[0]]
    clean = []
    for i, t, lang, source, n in kept:
        base = [(a, b) for a, _, b in brute_base(t or "")]
        spans = sorted(base + [(a, b) for a, b in brute_random(t or "") if not any(s <= a and b <= e for s, e in base)])
        out, hidden = [], [False] * len(t or "")
        for a, b in spans:
            hidden[a:b] = [True] * (b - a)
        starts = {a for a, b in spans if a == 0 or not hidden[a - 1] or all(not (s < a < e) for s, e in spans)}
        for k, c in enumerate(t or ""):
            if k in starts:
                out.append("[SECRET]")
            if not hidden[k]:
                out.append(c)
        clean.append((i, "".join(out), lang, source, n))
    times, size = brute_mix(clean)
    want = Counter()
    for r in clean:
        pieces = max(-(-size[r[0]] // packing.CAPACITY), 1)
        for k in range(pieces):
            want[r[0], k, pieces, min(packing.CAPACITY, size[r[0]] - k * packing.CAPACITY), r[3]] += times.get(r[0], 0)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["piece"], r["pieces"], r["size"], r["source"]) for r in rows) == +want
    cluster = {r[0]: " ".join(re.split(r"[\x20\x09-\x0D]+", r[1].lower())).strip() for r in clean}
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for b in bins.values():
        assert sum(r["size"] for r in b) <= packing.CAPACITY and max(Counter(r["source"] for r in b).values()) <= packing.PER_SOURCE
        assert max(Counter(cluster[r["doc_id"]] for r in b).values()) == 1


def test_stages_on_odd_tables(spark):
    for rows in (ROWS, []):
        docs = spark.createDataFrame([r[:5] for r in rows], SCHEMA.rsplit(",", 1)[0]).withColumns({c: F.lit("x") for c in ("size", "score", "_id", "_rows", "_times", "_row", "component", "shard", "cls")})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns, name
            assert {r["score"] for r in got.select("score").collect()} <= {"x"}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows) + (19 if rows else 0)
