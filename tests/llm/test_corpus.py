"""Operators on whole tables, against plain versions (brute.py) and SQL."""

from __future__ import annotations

import os
import random
import re

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from strawsift.llm import bpe, lines, mixing, neardup, oracles, pii, quality, queries, topk
from strawsift.llm.common import sieved
from strawsift.llm.components import components

from . import brute
from .conftest import DOCS, edited, prose

DATA = "/root/testdata/sf0.001"


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_queries_match_their_sql(spark, duck, name):
    mine, theirs = queries.queries()[name](spark, DATA), duck.sql(oracles.oracle_sql()[name])
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    assert key(mine.select(columns).collect()) == key(theirs.select(*columns).fetchall())


# components


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30), st.sampled_from([0, 3, 1 << 20]))
def test_components(spark, links, last):
    up = {x: x for pair in links for x in pair}

    def root(x):
        return x if up[x] == x else root(up[x])

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    found = components(spark.createDataFrame(links, "a long, b long"), last=last).collect()
    assert {r["node"]: r["component"] for r in found} == {x: root(x) for x in up}
    assert len(found) == len(up)


@pytest.mark.parametrize("last", [0, 50, 1 << 20])
def test_components_of_a_long_path(spark, last):
    order = list(range(400))
    random.Random(1).shuffle(order)
    found = components(spark.createDataFrame(list(zip(order, order[1:], strict=False)), "a long, b long"), last=last)
    assert found.where("component = 0").count() == 400


# near duplicates


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(edge, edge_rows, clashing, k, percent):
    truth = key((i, n, c, c is None or c == i) for i, n, c in brute.near_classes(edge_rows, k, percent))
    assert key(neardup.report(edge, k, percent).collect()) == truth
    assert key(neardup.report(clashing, k, percent).collect()) == truth


@pytest.mark.parametrize("last", [0, 1 << 20])
def test_families_of_near_copies(spark, monkeypatch, last):
    """Copies of a text at all distances, so that buckets hold many components; some link with no bucket's least member."""
    monkeypatch.setattr(neardup, "components", lambda links: components(links, last=last))
    rows, n = [], 0
    for family in range(3):
        base = prose(50 + family, 150)
        for i in range(45):
            n += 1
            rows.append((n * 7 % 1009, edited(base, (0.005, 0.01, 0.02, 0.03)[i % 4], n), "en", "s", None))
    df = spark.createDataFrame(rows, DOCS)
    for k, percent in ((3, 85), (5, 80)):
        truth = key((i, n, c, c == i) for i, n, c in brute.near_classes(rows, k, percent))
        assert 10 < len({c for _, _, c, _ in truth}) < len(rows)
        assert key(neardup.report(df, k, percent).collect()) == truth


def test_crossing_covers_chunks(spark, monkeypatch):
    """Step 2 by itself, over several chunks: all pairs of components that link are found."""
    monkeypatch.setattr(neardup, "CHUNK", 300)
    base = prose(9, 120)
    rows = [(i, edited(base, 0.02, i), "en", "s", None) for i in range(30)]
    sets = [brute.shingle_set(r[1], 3) for r in rows]
    inside = spark.createDataFrame([(i, i, 0) for i in range(30)], "a long, _c long, _lo long")
    found = {tuple(sorted(r)) for r in neardup.crossing(inside, spark.createDataFrame(rows, DOCS), 3, 85).collect()}
    assert found == {(i, j) for j in range(30) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}


@pytest.mark.parametrize("percent", [80, 85])
def test_prefixes_of_links_meet(spark, percent):
    """Sets that link share a shingle of their prefixes, whatever the order; sets far apart are left out by them."""
    base = prose(9, 120)
    rows = [(i, i, 0, edited(base, (0.01, 0.03, 0.3)[i % 3], i)) for i in range(30)] + [(30, 30, 0, ""), (31, 31, 0, None), (32, 32, 0, "two words")]
    met = neardup.with_sets(spark.createDataFrame(rows, "a long, _c long, _f long, _text string"), 3)
    full = {r["a"]: set(r["_set"]) for r in met.collect()}
    assert [len(full[i]) for i, _, _, _ in rows] == [len(brute.shingle_set(r[3], 3)) for r in rows]
    links = {(i, j) for j in full for i in full if i < j and full[i] and 100 * len(full[i] & full[j]) >= percent * len(full[i] | full[j])}
    assert links
    counts = neardup.slot_counts(met)
    assert counts.sum() == sum(map(len, full.values()))
    for order in (counts, counts * 0, -counts):
        first = {}
        for r in neardup.prefixes(met, percent, order).collect():
            first.setdefault(r["a"], set()).add(r["_t"])
        assert set(first) == {i for i in full if full[i]} and all(first[i] <= full[i] for i in first)
        assert all(len(first[i]) == len(full[i]) + 1 - -(-percent * len(full[i]) // 100) for i in first)
        meet = {(i, j) for j in first for i in first if i < j and first[i] & first[j]}
        assert links <= meet
        if order is counts:
            assert len(meet) < len(first) * (len(first) - 1) // 2


def test_one_of_each_class_stays(edge, edge_rows, clashing, empty):
    assert key(neardup.keep_one(edge).collect()) == key(brute.keep_one(edge_rows))
    assert neardup.keep_one(clashing).columns == clashing.columns
    assert neardup.keep_one(clashing).count() == len(brute.keep_one(edge_rows))
    assert neardup.keep_one(empty).count() == neardup.report(empty).count() == 0


def test_signatures_estimate_similarity():
    a = np.sort(np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64))
    b = np.sort(np.concatenate([a[:1500], np.random.default_rng(2).integers(0, 2**63, 500).astype(np.uint64)]))
    sig = neardup.signatures(np.concatenate([a, b]), np.array([0, 2000, 2000, 4000]), 1024)
    assert len(sig) == 2  # an empty set has none
    assert abs((sig[0] == sig[1]).mean() - 1500 / 2500) < 0.06


# lines


def test_line_dedup(spark, edge, edge_rows, clashing, empty):
    passage = "\n".join(prose(77, 60).split("\n"))
    extra = [(100 + i, f"{prose(200 + i, 20)}\n\n{passage if i % 2 else passage.replace(chr(10), ' ' + chr(10) + '  ')}\n{prose(300 + i, 20)}", "en", "s", None) for i in range(5)]
    extra.append((200, "x\nx\nx\nx\nx", "en", "s", 9))
    rows = edge_rows + extra
    df = edge.unionByName(spark.createDataFrame(extra, DOCS))
    truth = brute.line_dedup(rows)
    assert sum(r[5] for r in truth) > 30
    assert key(lines.dedup(df).collect()) == key(r[:5] for r in truth)
    assert key(lines.report(df).collect()) == key((r[0], r[5], None if r[1] is None else brute.digest(r[1])) for r in truth)
    assert lines.dedup(clashing).columns == clashing.columns
    assert lines.dedup(empty).count() == lines.report(empty).count() == 0


# quality


def test_quality(spark, edge, edge_rows, clashing, empty, monkeypatch):
    monkeypatch.setattr(quality, "LEAST", 4)
    extra = [(300 + i, prose(400 + i, 60) + " ###" * (7 if i == 0 else 0) + "\nsame line here" * (i % 3) * 2, "en", "s0", None) for i in range(25)]
    rows = edge_rows + extra
    df = edge.unionByName(spark.createDataFrame(extra, DOCS))
    truth = brute.verdicts(rows, 4)
    assert key(quality.verdicts(df).collect()) == key(truth)
    assert any(not r[6] and not r[7] for r in truth) and sum(r[7] for r in truth) > 40
    good = key(quality.keep_good(df).collect())
    assert good == key(r for r, v in zip(rows, truth, strict=True) if v[7])
    assert quality.keep_good(clashing).columns == clashing.columns
    assert quality.verdicts(empty).count() == quality.keep_good(empty).count() == 0


def test_thresholds_follow_their_source(spark):
    """A source rich in symbols, one rich in long words and one of lists of equal lines keep their own; each rejects what is odd in it."""
    r = random.Random(4)
    rows = []

    def add(source, text):
        rows.append((len(rows), text, "en", source, None))

    for i in range(60):
        text = prose(600 + i, r.randrange(80, 200))
        add("plain", text)
        add("code", re.sub(r"[ \n]", lambda m: " $ " if r.random() < 0.4 else m.group(), text))
        add("long", " ".join(w + v for w, v in zip(text.split(), text.split()[1:], strict=False)))
        add("listed", "\n".join(x for j, x in enumerate(text.split("\n")) for _ in range(4 if j == 0 else 1)) + "\n" + prose(900 + i, 9 * r.randrange(4, 30)))
    odd = {"plain": ["$ ", "a ", ""], "code": ["$ # "], "long": ["a "], "listed": []}
    wrong = set()
    for source, parts in odd.items():
        for part in parts:
            wrong.add(len(rows))
            add(source, prose(7000 + len(rows), 60) + "\n" + part * 300 if part else "\n".join([prose(7777, 9)] + ["same"] * 40 + [prose(7778, 120)]))
    df = spark.createDataFrame(rows, DOCS)
    found = {v["doc_id"]: v for v in quality.verdicts(df).collect()}
    assert {i for i, v in found.items() if not v["kept"] and not v["base_failed"]} | {i for i in wrong if found[i]["base_failed"]} == wrong
    limits = quality.thresholds(quality.sketches(quality.measured(df, ("doc_id",)))).collect()
    for i, m in enumerate(quality.MEASURES):
        assert len({t[f"most{i}"] for t in limits}) > 1, m.name


def test_sketches_merge(edge):
    rows = quality.measured(edge, ("doc_id",))
    half = F.pmod(F.hash("_row"), F.lit(2))
    parts = quality.sketches(rows.where(half == 0)).unionByName(quality.sketches(rows.where(half == 1)))
    merged = parts.groupBy("_lang", "_source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert key(merged.collect()) == key(quality.sketches(rows).collect())


# mixing


def test_mixing(edge, edge_rows, clashing, empty):
    truth = brute.mix(edge_rows, mixing.SEED)
    for df in (edge, clashing):
        found = mixing.shares(df).collect()
        assert key((r[0], r[1], r[2], round(r[3], 6), r[4]) for r in found) == key((i, n, s, round(t, 6), c * n) for i, n, s, t, c in truth)
    mixed = mixing.mix(edge).collect()
    assert key(mixed) == key(r for r, (*_, c) in zip(edge_rows, truth, strict=True) for _ in range(c))
    assert mixing.mix(clashing).columns == clashing.columns
    assert mixing.mix(empty).count() == mixing.shares(empty).count() == 0


def test_mixes_come_near_their_targets(spark):
    r = random.Random(8)
    rows = [(i, "w " * r.randint(1, 60), "en", f"s{min(int(r.expovariate(0.7)), 9)}", None) for i in range(4000)]
    found = mixing.shares(spark.createDataFrame(rows, DOCS)).groupBy(F.col("source_size")).agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(x["taken"] - x["target"]) <= 60 for x in found)
    assert abs(sum(x["target"] for x in found) - sum(x["source_size"] for x in found)) < 1e-3


def test_rows_without_ids_and_repeated_rows_come_near_the_targets(spark):
    """All ids null, the same text again and again, in several partitions: as many rows are taken as the target has words for."""
    rows = [(None, "a b c d" if i % 3 else f"a b c {i}", "en", "a" if i < 1200 else "b", None) for i in range(2000)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    goals = {s: t for _, _, s, t, _ in brute.mix(rows, mixing.SEED)}
    for given in (df, spark.createDataFrame([(7, "a b c d", "en", r[3], None) for r in rows], DOCS).repartition(3)):
        for found in (mixing.shares(given).groupBy("source_size", "target").agg(F.sum("taken"), F.max("taken")).collect(),):
            assert len(found) == 2 and all(abs(taken - target) <= 4 and most <= 12 and abs(target - goals[size]) < 1e-6 for size, target, taken, most in found)
        mixed = mixing.mix(given).groupBy("source").count().collect()
        assert all(abs(4 * n - goals[4800 if s == "a" else 3200]) <= 4 for s, n in mixed)


def test_document_weights_are_inclusion_odds(spark):
    """Over many seeds a document is taken as often as its weight says, and every mix has the target's words."""
    rows = [(i, "w " * 10, "en", "a" if i < 120 else "b", None) for i in range(240)]
    df = spark.createDataFrame(rows, DOCS)
    weight = F.when(F.col("doc_id") % 3 == 0, 3)
    taken, runs = {}, 12
    for seed in range(runs):
        found = mixing.shares(df, weights=(1, 5), seed=f"t{seed}", weight=weight).collect()
        for r in found:
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"] / 10
        a = [r for r in found if r["doc_id"] < 120]
        assert abs(sum(r["taken"] for r in a) - a[0]["target"]) <= 10
        assert max(r["taken"] for r in found) <= 30
    # source a: a third of its words is wanted, so weights 3 and 1 are taken with 0.6 and 0.2
    heavy = sum(taken[i] for i in range(0, 120, 3)) / 40 / runs
    light = sum(taken[i] for i in range(120) if i % 3) / 80 / runs
    assert abs(heavy - 0.6) < 0.06 and abs(light - 0.2) < 0.04


# personal data


@settings(max_examples=400, deadline=None)
@given(st.text("aZ1234567890..@@--+++()  %é_", max_size=50) | st.text("0123456789.+- ", max_size=60))
def test_base_spans(text):
    found = pii.base_spans(text)
    assert [f"{pii.KINDS[k]}:{a}:{b}" for k in range(4) for a, b in found[k]] == brute.base_spans(text)
    more = pii.further_spans(text, found)
    spans = sorted([s for kind in found for s in kind])
    assert all(a >= y or b <= x for _, a, b in more for x, y in spans)


def test_personal_data_query(spark, edge, edge_rows, clashing, empty):
    planted = [
        (500, "write to ann.lee (at) mail.example.com today", "email:9:38"),
        (501, "no 4111111111111111 5500005555555559 here", None),
        (502, "call +1 (269) 555-3296 190.137.223.204 now", None),
        (503, "version 1.2.3.4 of it", None),
        (504, "", None),
        (505, "the 2001:0db8:0000:0000:0000:ff00:0042:8329 host", "ip:4:43"),
        (506, "the number 2123465659789240 is none", None),
    ]
    many = [(600 + i, f"mail a{i}@b{i}.example.org or +1 (20{i % 10}) 555-01{i % 90 + 10} or {'4111 1111 1111 1111' if i % 2 else '5500005555555559'} or 10.0.{i % 200}.{i % 250 + 1} end", "en", "s", None) for i in range(200)]
    decoys = [(900 + i, f"lot {7 * 10**15 + i * 7919 * 1013} end", "en", "s", None) for i in range(60)]
    df = edge.unionByName(spark.createDataFrame([(i, t, "en", "s", None) for i, t, _ in planted] + many + decoys, DOCS))
    rows = [*edge_rows, *((i, t) for i, t, _ in planted), *many, *decoys]
    found = pii.report(df).collect()
    truth = {}
    for r in rows:
        truth.setdefault(r[0], []).append(brute.base_spans(r[1] or ""))
    assert len(found) == len(rows)
    for r in found:
        assert any(r["base_sha256"] == pii.digest(b) and [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in b) for k in pii.KINDS] and set(b) <= set(r["spans"].split(",") if r["spans"] else []) for b in truth[r["doc_id"]])
    spans = {r["doc_id"]: r["spans"] for r in found}
    for i, _, s in planted:
        if s:
            assert s in spans[i].split(",")
    assert spans[501] == "card:3:19,card:20:36" and spans[503] == "ip:8:15" and spans[506] == "" == spans[504]
    assert not any(spans[900 + i] for i in range(60) if not pii._luhn(str(7 * 10**15 + i * 7919 * 1013)))
    assert pii.report(clashing).count() == len(edge_rows) and pii.report(empty).count() == 0
    assert pii.masked("a b@c.de f", ["email:2:8"]) == "a [email] f"


def test_em_finds_who_is_right():
    """Votes drawn from known reliabilities, for one kind."""
    r = np.random.default_rng(4)
    truth = r.random(6000) < 0.4
    right = np.array([0.95, 0.99, 0.8, 0.6, 0.7, 0.9])
    votes = np.where((r.random((6000, 6)) < right) == truth[:, None], 1, -1)
    counts: dict[int, int] = {}
    keys = [pii._key(2, v.tolist()) for v in votes]
    for k in keys:
        counts[k] = counts.get(k, 0) + 1
    p = pii.reliabilities(counts)
    assert np.mean([(p[k] > 0.5) == t for k, t in zip(keys, truth, strict=True)]) > 0.98


# top-k


def _best(ids, vectors, queries, k):
    out = []
    for q in queries:
        scores = vectors @ vectors[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:k]
        out += [(int(q), n + 1, int(ids[i]), int(scores[i])) for n, i in enumerate(order)]
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 60), st.integers(1, 6), st.integers(0, 1000), st.sampled_from([1, 3, 40, 10**6, 10**8]), st.integers(1, 25))
def test_index_is_exact(n, width, seed, size, k):
    r = np.random.default_rng(seed)
    vectors, ids = r.integers(-size, size + 1, (n, width)), r.permutation(n * 3)[:n]
    q = ids[ids % 2 == 0]
    asked = np.array([vectors[np.flatnonzero(ids == x)[0]] for x in q]).reshape(len(q), width)
    a, b, s = topk.Index(ids, vectors).search(asked, k, q)
    a = q[a]
    found = [(int(x), int(y), int(z)) for x, y, z in zip(a, b, s, strict=True)]
    assert found == [(x, y, z) for x, _, y, z in _best(ids, vectors, q, k)]


@pytest.mark.parametrize("width", [32, 64])
def test_processing_stops_early(width):
    """On directions at random, about the hardest case, a good part of the postings is never processed, and the ranking is exact."""
    r = np.random.default_rng(width)
    x = r.standard_normal((4096, width))
    vectors, ids = np.floor(64 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64), np.arange(4096)
    index = topk.Index(ids, vectors)
    a, b, s = index.search(vectors[::64], 20, ids[::64])
    assert [(int(ids[::64][x]), int(y), int(z)) for x, y, z in zip(a, b, s, strict=True)] == [(x, y, z) for x, _, y, z in _best(ids, vectors, ids[::64], 20)]
    assert 0 < index.read < 0.85 * index.held


def test_repeated_rows_count_once(spark):
    rows = [(i % 40, [float(i % 13), float(i % 7)]) for i in range(40)] * 3 + [(0, [5.0, 1.0])] * 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    theirs = con.execute(oracles.oracle_sql()["op2_topk"]).fetchall()
    assert len(theirs) == 60
    assert key(topk.report(df).select("query_id", "rank", "vec_id", "score").collect()) == key(theirs)


def test_top_k_query(spark):
    r = np.random.default_rng(6)
    x = r.standard_normal((300, 8)).astype(np.float32)
    x[100:200] = x[100]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(400, None), (420, [1.0, None]), (440, [float("nan")] * 8), (460, [float("inf")] * 8), (None, [9.0] * 8), (480, [0.5, 0.25]), (500, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("_id", F.lit(1)).withColumn("rank", F.lit("x"))
    whole = {i: [int(np.floor(64 * float(np.float32(c)))) for c in v] for i, v in rows if i is not None and i not in (400, 420, 440, 460)}
    ids = np.array(sorted(whole))
    vectors = np.array([whole[i] + [0] * (8 - len(whole[i])) for i in ids])
    truth = _best(ids, vectors, [i for i in ids if i % 20 == 0], 20)
    assert key(topk.report(df).collect()) == key(truth)
    parts = topk.search(topk.whole(df), topk.whole(df).where("_id % 20 = 0"), 20, block=50, group=7)
    assert key(parts.collect()) == key(truth)
    assert topk.report(df.limit(0)).count() == 0


# pipeline


def test_pipeline(spark, edge_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "LEAST", 4)
    passage = prose(78, 40)
    extra = [(700 + i, f"{prose(800 + i, 60)}\n{passage}\n{prose(900 + i, 30)}", "en", f"s{i % 3}", None) for i in range(6)]
    rows = edge_rows + extra
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    good = [r for r, v in zip(rows, brute.verdicts(rows, 4), strict=True) if v[7]]
    kept = brute.keep_one([r[:5] for r in brute.line_dedup(good)])
    truth = []
    for r, (*_, copies) in zip(kept, brute.mix(kept, mixing.SEED), strict=True):
        ids = bpe.codec().encode(r[1] or "")
        truth += [(r[0], r[2], r[3], len(ids) // 4, ids, True)] * copies
    found = [(*r[:4], bytes(r[4]), r[5]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert key(found) == key(truth)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == len(truth)


# sieves


@pytest.mark.parametrize("bits", [1 << 15, 1 << 25])
def test_a_sieve_loses_nothing(spark, bits):
    """Whatever the size, all rows that are wanted pass, nulls too; others seldom do while the sieve is large; columns stay."""
    rows = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("_slot0"))
    wanted = rows.where("k IS NULL OR k % 50 = 0").select("k")
    found = sieved(rows, ["k"], wanted.unionByName(wanted), bits)
    assert found.columns == [*rows.columns, "_maybe"] and found.count() == 5000
    passed = {r["k"] for r in found.where("_maybe").collect()}
    assert passed >= {r["k"] for r in wanted.collect()} and len(passed) <= (100 if bits > 1 << 20 else 150)
    assert sieved(rows, ["k"], wanted.where("false"), bits).where("_maybe").count() == 0
