"""Operators on single rows: kernel, sharding, tokenizers, language model."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strawsift.llm import bpe, lm, sharding, textkernel, unigram
from strawsift.llm import recurrent as R

from .conftest import DOCS, words_of

TEXTS = st.lists(st.text("aB \n\t\x0b\x1f\x85é漢. ", max_size=40), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_kernel_words_and_lines(texts):
    raw = [t.encode() for t in texts]
    seen = {}
    for size in (1, 64, 1 << 20):
        at = 0
        for start, stop, b in textkernel.blocks(raw, size=size):
            assert start == at
            at = stop
            hashes = b.word_hashes()
            for i, t in enumerate(texts[start:stop]):
                mine = hashes[b.first[i] : b.first[i + 1]].tolist()
                assert len(mine) == len(words_of(t))
                for w, h in zip(words_of(t), mine, strict=True):
                    assert seen.setdefault(w, h) == h
            assert len(b.lines()[0]) == sum(len(t.split("\n")) for t in texts[start:stop])
        assert at == len(raw)
    assert len(set(seen.values())) == len(seen)


# sharding


def test_the_table_is_what_turns_give():
    shards, size = ("a", "b", "c"), 31
    order = {s: [(sharding._number(s, "offset") % size + j * (1 + sharding._number(s, "step") % (size - 1))) % size for j in range(size)] for s in shards}
    table, turn = [None] * size, 0
    while None in table:
        shard = turn % 3
        table[next(x for x in order[shards[shard]] if table[x] is None)] = shard
        turn += 1
    assert sharding.lookup_table(shards, size) == table


def test_shares_are_even_and_losses_small():
    table = sharding.lookup_table()
    share = Counter(table)
    assert max(share.values()) - min(share.values()) <= 1
    names = sharding.SHARDS[:-1]
    fewer = sharding.lookup_table(names)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a < len(names))
    assert moved < 0.05 * len(table)
    turns = Counter(sharding.lookup_table(("a", "b"), 997, {"a": 3}))
    assert abs(turns[0] / turns[1] - 3) < 0.05
    for bad in (((), 31), (("a", "a"), 31), (("a",), 30)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_placing(spark, edge, clashing, empty, tmp_path):
    from pyspark.sql import functions as F

    table = sharding.lookup_table()
    for df in (edge, clashing.withColumn("slot", F.lit("x")).withColumn("_slot", F.lit("x"))):
        rows = sharding.place(df, F.col("doc_id")).select("doc_id", "slot", "shard").collect()
        assert len(rows) == edge.count()
        for r in rows:
            key = "" if r["doc_id"] is None else str(r["doc_id"])
            slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SIZE
            assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert sharding.place(empty, F.col("doc_id")).count() == 0
    sharding.write_shards(sharding.place(edge, F.col("doc_id")), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == edge.count()


# BPE


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@settings(max_examples=200, deadline=None)
@given(st.text("abcd '\n\t.,!0١éü漢😀\x85sdmtrevl", max_size=60) | st.text(max_size=30))
def test_bpe_is_the_library(byte_bpe, text):
    codec = bpe.codec()
    for t in (text, text + "<|endoftext|>" + text[::-1]):
        t = t.encode("utf-8", "ignore").decode()
        ids = byte_bpe.encode(t, add_special_tokens=False).ids
        mine = codec.encode(t)
        assert np.frombuffer(mine, "<u4").tolist() == ids
        assert codec.decode(mine) == byte_bpe.decode(ids, skip_special_tokens=False) == t


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=127), max_size=40) | st.text("ab1 '\n\t\x1c\x1f.strevl", max_size=40))
def test_bpe_of_ascii_is_the_library(byte_bpe, text):
    assert np.frombuffer(bpe.codec().encode(text), "<u4").tolist() == byte_bpe.encode(text, add_special_tokens=False).ids


def test_bpe_long_runs(byte_bpe):
    for t in ("a" * 30_000, "ab" * 9_000, " " * 5_000, "=" * 7_001):
        assert np.frombuffer(bpe.codec().encode(t), "<u4").tolist() == byte_bpe.encode(t, add_special_tokens=False).ids


def test_bpe_merges_by_rank_then_place():
    """The tree against a plain search for the leftmost lowest rank."""
    codec = bpe.codec()
    random.seed(4)
    for _ in range(300):
        ids = [codec.id_of_byte[b] for b in "".join(random.choice("aabtheing") for _ in range(random.randint(0, 30))).encode()]
        plain = list(ids)
        while True:
            ranked = [(codec.merges[k][0], i) for i in range(len(plain) - 1) if (k := plain[i] << 32 | plain[i + 1]) in codec.merges]
            if not ranked:
                break
            i = min(ranked)[1]
            plain[i : i + 2] = [codec.merges[plain[i] << 32 | plain[i + 1]][1]]
        assert codec.merge(list(ids)) == plain


def test_bpe_words_grow_together(monkeypatch):
    """Pre-tokens of up to 65 bytes are merged side by side, as each alone is, whatever the number of rows of an array."""
    codec = bpe.Codec(bpe.default_path())
    random.seed(5)
    words = [b"", b"a", bytes(range(256))]
    words += ["".join(random.choice(letters) for _ in range(n)).encode() for letters in ("aabtheing", "ab", " =", "é漢th", "a") for n in range(80)]
    alone = [bpe.packed(codec.merge([codec.id_of_byte[b] for b in w])) for w in words]
    one, long = codec.merge, []
    monkeypatch.setattr(codec, "merge", lambda ids: long.append(len(ids)) or one(ids))
    for nodes in (bpe.NODES, 128):
        monkeypatch.setattr(bpe, "NODES", nodes)
        assert codec.merge_all(words) == alone
    assert not [n for n in long if 2 <= n <= 65]


def test_bpe_ranks_of_pairs():
    codec = bpe.codec()
    known = np.array(list(codec.merges), np.int64)
    rank = [place >> 32 for place, _ in codec.merges.values()]
    assert codec._ranks.of(known >> 32, known & 0xFFFFFFFF).tolist() == rank
    some = np.random.default_rng(6).integers(-1, len(codec.bytes_of), (2, 200_000))
    truth = [codec.merges.get(a << 32 | b, (-1 << 32, 0))[0] >> 32 for a, b in zip(*some.tolist(), strict=True)]
    assert codec._ranks.of(*some).tolist() == truth
    full = bpe.Ranks({a << 32 | 7: a for a in range(9)})
    assert full.of(np.arange(20), np.full(20, 7)).tolist() == [*range(9), *[-1] * 11]


def test_bpe_in_pieces(byte_bpe, monkeypatch):
    """Neither the pieces that a text is looked up in, nor the table's bound, nor the texts beside it change its ids."""
    codec = bpe.Codec(bpe.default_path())
    texts = ["", "a b c d e f g", "x" * 70 + " x", "<|endoftext|>one<|endoftext|>", "漢字 é\n\n  two", "one two " * 9, "", "=" * 65 + "é"]
    truth = [byte_bpe.encode(t, add_special_tokens=False).ids for t in texts]
    for together, kept, ids in ((1 << 17, 250_000, 1 << 18), (3, 250_000, 5), (4, 5, 1), (1, 0, 2)):
        for name, value in (("TOGETHER", together), ("KEPT", kept), ("IDS", ids)):
            monkeypatch.setattr(bpe, name, value)
        for _ in range(2):
            coded = codec.encode_all(texts)
            assert [np.frombuffer(x, "<u4").tolist() for x in coded] == truth
            assert codec.decode_all(coded) == texts
            assert not [w for w in codec.kept if len(w) > bpe.KEPT_LENGTH] and len(codec.kept) <= max(kept, together)
    assert codec.encode_all([]) == codec.decode_all([]) == []
    assert list(bpe.grouped(["aa", "b", "cccc", "", "d"], 3)) == [["aa", "b"], ["cccc"], ["", "d"]]


def test_bpe_query(byte_bpe, edge, edge_rows, clashing, empty):
    for df in (edge, clashing):
        found = sorted(map(tuple, bpe.digests(df).collect()), key=repr)
        truth = []
        for i, text, *_ in edge_rows:
            ids = byte_bpe.encode(text or "", add_special_tokens=False).ids
            truth.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(byte_bpe.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert found == sorted(truth, key=repr)
    coded = bpe.decode(bpe.encode(clashing))
    assert coded.where("coalesce(text, '') <> decoded").count() == 0
    assert bpe.digests(empty).count() == 0


# unigram


@pytest.fixture(scope="module")
def piece_unigram():
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.Unigram(unigram.pieces(unigram.default_path()), unk_id=0, byte_fallback=True))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


@settings(max_examples=200, deadline=None)
@given(st.text("abcthering  ▁\n.,0é漢😀<s>x", max_size=60) | st.text(max_size=30))
def test_token_counts_are_the_library(piece_unigram, text):
    text = text.encode("utf-8", "ignore").decode()
    assert unigram.counter().count(text)[0] == len(piece_unigram.encode(text, add_special_tokens=False).ids)


def test_ties_and_fallback():
    from tokenizers import Tokenizer, models

    vocab = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("bc", -2.0), ("c", -1.0), ("abc", -3.0), ("cd", -9.0)]
    theirs, mine = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False)), unigram.Counter(vocab)
    for i in range(3000):
        random.seed(i)
        word = "".join(random.choice("abcdé") for _ in range(random.randint(1, 9)))
        assert mine.best(word)[0] == len(theirs.encode(word, add_special_tokens=False).ids), word


def test_token_count_query(piece_unigram, edge, edge_rows, clashing, empty):
    truth = sorted(((r[0], len(piece_unigram.encode(r[1] or "", add_special_tokens=False).ids)) for r in edge_rows), key=repr)
    for df in (edge, clashing):
        assert sorted(map(tuple, unigram.count_tokens(df).select("doc_id", "n_tokens").collect()), key=repr) == truth
    assert unigram.count_tokens(empty).count() == 0


# language model


def test_gradients(monkeypatch):
    monkeypatch.setattr(R, "WIDTH", 4)
    monkeypatch.setattr(R, "_f", np.float64)
    random_ = np.random.default_rng(0)
    m = R.Model(np.array([5, 3, 2, 8, 1, 1.0]), np.array([3.0, 2.0]), hidden=5)
    before, y = random_.integers(0, 8, (4, 3)), random_.integers(0, 8, (4, 3))
    before[2, 1] = m.start
    alive = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    h = random_.standard_normal((3, 5)) * 0.3
    g, (used, gates), _, _ = m.gradients(before, y, alive, h)
    g["gates"] = np.zeros(m.p["gates"].shape)
    g["gates"][used] = gates
    for name, x in m.p.items():
        x, slope = x.ravel(), g[name].ravel()
        for i in random_.choice(len(x), 8):
            if abs(x[i]) > 1e6:
                continue
            was, ends = x[i], []
            for d in (1e-5, -1e-5):
                x[i] = was + d
                ends.append(m.gradients(before, y, alive, h)[3])
            x[i] = was
            assert abs((ends[0] - ends[1]) / 2e-5 / alive.sum() - slope[i]) < 1e-5


@pytest.mark.parametrize("texts", [1, 20, 700])
def test_training_passes_once_over_few_texts_as_over_many(texts, monkeypatch):
    m, made = R.Model(np.arange(200, 0, -1.0), np.ones(4)), []
    symbols = np.random.default_rng(3).integers(0, 204, texts * 40)
    whole = m.gradients
    monkeypatch.setattr(m, "gradients", lambda before, y, alive, h: made.append(alive.sum()) or whole(before, y, alive, h))
    m.train(symbols, np.arange(0, texts * 40 + 1, 40))
    assert sum(made) == len(symbols)


def test_scores_carry_the_state_over_whole_texts():
    m = R.Model(np.arange(200, 0, -1.0), np.ones(4))
    random_ = np.random.default_rng(1)
    lengths = [1, 0, 700, 16, 17, 3]
    symbols, first = random_.integers(0, 204, sum(lengths)), np.concatenate([[0], np.cumsum(lengths)])
    found = m.score(symbols, first, together=2, pending=50)
    for i in range(len(lengths)):
        h, before, total = np.zeros((1, m.hidden), np.float32), m.start, 0.0
        for y in symbols[first[i] : first[i + 1]]:
            h = m._step(np.array([before]), h)[0]
            total += m.log_probability(h, np.array([y]))[0]
            before = y
        assert abs(found[i] - total) < 1e-3
    assert abs(np.exp(m.log_probability(np.repeat(h, 204, 0), np.arange(204))).sum() - 1) < 1e-5


def _vocabulary(spark, words):
    return lm.Vocabulary(spark.createDataFrame(pa.table({"h": words.view(np.int64), "tail": np.zeros(len(words), np.int32), "n": np.arange(len(words)) + 1})))


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_known_words_are_found(spark, n):
    """All known words, whatever bits they begin with, and no others."""
    words = textkernel.mix(np.arange(n, dtype=np.uint64))
    words[n // 2 :] >>= np.uint64(40)  # a part that begins alike
    words = np.unique(np.append(words, np.array([0, 2**64 - 1], np.uint64)[: n // 3]))
    others = np.setdiff1d(np.concatenate([words + np.uint64(1), words - np.uint64(1)]), words)
    v = _vocabulary(spark, words[::-1].copy())
    asked = np.concatenate([others, words])
    found, _ = v.look_up(asked, np.zeros(len(asked), np.int64))
    assert found.tolist() == [0] * len(others) + list(range(len(words), 0, -1))


def test_words_are_found_without_a_binary_search(spark):
    """Looking words up takes less CPU time than a search through all that are known, which it contained."""
    words = textkernel.mix(np.arange(600_000, dtype=np.uint64))
    v, tails = _vocabulary(spark, words), np.zeros(200_000, np.int64)
    asked = np.random.default_rng(0).choice(textkernel.mix(np.arange(900_000, dtype=np.uint64)), len(tails))

    def least(f):
        took = []
        for _ in range(5):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert least(lambda: v.look_up(asked, tails)) < 0.9 * least(lambda: np.searchsorted(v.h, asked))


def test_scoring_holds_little_at_once():
    """What it takes anew for some states is so little that the allocator keeps it: larger pieces go back to the machine each time."""
    m = R.Model(np.arange(1024, 0, -1.0), np.ones(32))
    symbols = np.random.default_rng(1).integers(0, 1056, 3000 * 20)
    tracemalloc.start()
    m.score(symbols, np.arange(0, len(symbols) + 1, 20))
    assert tracemalloc.get_traced_memory()[1] < 8e6
    tracemalloc.stop()


@pytest.mark.parametrize("width", [1, 5, 6])
def test_sums_of_rows_that_stand_together(width):
    x = np.random.default_rng(2).standard_normal((40, width)).astype(np.float32)
    assert np.allclose(R._sums(x, np.array([0, 1, 17])), [x[:1].sum(0), x[1:17].sum(0), x[17:].sum(0)], atol=1e-5)


def test_shares_of_large_and_small_logits():
    for shift in (0, 300, -300):
        logit = np.array([[1, 2], [3, -400], [0, 5]], np.float32) + np.float32(shift)
        e, total, top = R._powers(logit)
        assert np.allclose(np.log(total) + top, np.logaddexp.reduce(logit.astype(float), axis=0), atol=1e-4)
        assert np.allclose((e / total).sum(axis=0), 1)


def _base(rows):
    train = Counter()
    for i, text, *_ in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update([*words_of(text, lower=True), None])
    total, distinct = sum(train.values()), len(train)
    out = []
    for i, text, *_ in rows:
        tokens = [*words_of(text, lower=True), None]
        held = zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
        out.append((i, held, len(tokens), sum(train[t] > 0 for t in tokens), total, sum(math.log10((train[t] + 1) / (total + distinct + 1)) for t in tokens)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("known", [1_000_000, 60])
def test_language_model_query(spark, edge, edge_rows, clashing, empty, known, monkeypatch):
    """With few known words, the others' counts come by a join."""
    monkeypatch.setattr(lm, "KNOWN", known)
    monkeypatch.setattr(lm, "HEAD", 40)
    monkeypatch.setattr(lm, "SHARE", 2)
    truth = _base(edge_rows)
    rows = lm.scored(edge if known > 60 else clashing).collect()
    found = sorted((tuple(r)[:6] for r in rows), key=repr)
    assert [f[:5] for f in found] == [t[:5] for t in truth]
    assert all(abs(f[5] - t[5]) < 1e-6 * abs(t[5]) for f, t in zip(found, truth, strict=True))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lm.scored(empty).count() == 0


def test_the_rounds_learn_from_every_training_document(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", "s", None) for i in range(400)], DOCS)
    rows = lm.encoded(docs, lm.Vocabulary(lm.word_counts(docs)))
    seen = sorted(r["doc_id"] for turn in range(lm.ROUNDS) for r in lm.lesson(rows, turn).collect())
    assert seen == [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]


def test_scores_follow_from_the_documents_alone(spark, edge, edge_rows, monkeypatch):
    """The query's scores against the model run step by step over each whole text, and the same scores from files of another layout."""
    monkeypatch.setattr(lm, "HEAD", 40)
    monkeypatch.setattr(lm, "SHARD", 20)
    monkeypatch.setattr(lm, "TOGETHER", 1000)
    counts = lm.word_counts(edge)
    v = lm.Vocabulary(counts)
    m = lm.trained(lm.encoded(edge, v), v)
    other = lm.trained(lm.encoded(edge.repartition(1), v), v)
    assert np.allclose(m.flat(), other.flat(), atol=1e-6)
    train = Counter()
    for i, text, *_ in edge_rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            train.update([*words_of(text, lower=True), None])
    found = {}
    for r in lm.scored(edge).collect():
        found.setdefault(r["doc_id"], []).append(r["score"])
    head = {int(h): s for h, s in zip(v.h, v.symbol, strict=True) if s >= 0}
    for i, text, *_ in edge_rows:
        if i is None or i < 20:
            continue
        block = lm.Block([text.encode()], lower=True)
        hashes, tails, _ = lm._tokens(block)
        h, before, total = np.zeros((1, m.hidden), np.float32), m.start, 0.0
        for x, t, word in zip(hashes, tails, [*words_of(text, lower=True), None], strict=True):
            y = head.get(int(x), m.words + int(t))
            h = m._step(np.array([before]), h)[0]
            total += m.log_probability(h, np.array([y]))[0] / math.log(10)
            if y >= m.words:
                total += math.log10((train[word] + 1) / (v.tail_n[t] + v.tail_words[t] + 1))
            before = y
        assert abs(found[i][0] - total) < 1e-3


def test_the_model_beats_its_base_on_held_out_texts(spark):
    """Texts whose every word depends on the one before."""
    r = random.Random(2)
    follow = {f"w{i}": [f"w{r.randrange(60)}" for _ in range(2)] for i in range(60)}
    rows = []
    for i in range(700):
        word, made = f"w{r.randrange(60)}", []
        for _ in range(60):
            made.append(word)
            word = r.choice(follow[word])
        rows.append((i, " ".join(made), "en", "s", None))
    found = lm.scored(spark.createDataFrame(rows, DOCS)).where("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert found[0] > 0.85 * found[1]
    assert re.match(r"-\d", str(found[0]))


def test_texts_go_to_the_encoder_once(spark):
    """The encoding stage does not also carry the text along to drop it: that was twice the memory of a batch, on both sides."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "en", "a", "one two"), (2, "en", "a", None)], "doc_id long, lang string, source string, text string")
    for coded in (corpus_pipeline.encode(spark, docs, ""), bpe.digests(docs)):
        row = re.search(r"struct\((.*?)\) AS _row", coded._jdf.queryExecution().analyzed().toString())[1]
        assert "doc_id" in row and "text" not in row
    kept = bpe.encode_checked(docs).orderBy("doc_id").collect()
    assert [(r["text"], r["round_trip"]) for r in kept] == [("one two", True), (None, True)]


def test_a_worker_gives_memory_back():
    """What a task has freed is not held by its worker's allocators."""
    held = lambda: int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    def run(batches):
        for n in batches:
            words = [bytes(1000) for _ in range(n)]
            pins.append(bytes(1000))  # lies behind them, so they are not at the end of the heap
            yield len(words)

    pins, before = [], held()
    assert list(textkernel.resting(run)([200_000])) == [200_000]
    assert held() - before < 60


def test_powers_are_those_of_the_base():
    textkernel._grow(10)
    assert len(textkernel._powers) == len(textkernel._inverses) >= textkernel.BLOCK_BYTES + 2
    for i in (0, 1, 2, 999_983):
        assert int(textkernel._powers[i]) == pow(textkernel._BASE, i, 1 << 64) and int(textkernel._inverses[i]) == pow(textkernel._INVERSE, i, 1 << 64)
