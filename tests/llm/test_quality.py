import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import batches, features, quality_mil, quality_rules

TEXTS = [
    "", None, " \n\t ", "one", "a b c d e f a b c d e g", "x y\nx y\n\nx y\n \n z", "é ü\x0bß# *$%&|<>", "w " * 30, "a b c", "\n\nq\nq", "l\n l\nl",
    "a a a a a a a", "long " * 5000,
]


def brute(text):
    words = (text or "").encode().split()
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts: dict = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    hit = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)}
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(len(w.decode()) for w in words), symbols, dup, len(hit), failed


def counted(texts):
    got = quality_rules.judge_slice(pa.array(texts, pa.string()), None)
    return [tuple(int(got[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) + (bool(got["base_failed"][i]),) for i in range(len(texts))]


def test_counts():
    assert counted(TEXTS) == [brute(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n\té#", max_size=40), min_size=1, max_size=5))
def test_counts_anywhere(texts):
    assert counted(texts) == [brute(t) for t in texts]


def test_slices_do_not_matter():
    assert counted(TEXTS) == [counted([t])[0] for t in TEXTS]


@pytest.fixture(scope="module")
def corpus(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    return read("documents"), read("labels")


def held(docs, labels):
    rows = docs.select("doc_id").join(labels, "doc_id").collect()
    return {r.doc_id: r.quality for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}


def test_quality_rules_hold_out_and_edges(spark, corpus):
    docs, labels = corpus
    outside = labels.filter(~quality_mil.held_out("doc_id"))
    model = quality_rules.train(outside, docs)
    truth = held(docs, labels)
    got = {r.doc_id: r.probability >= 0.5 for r in quality_rules.judge(docs, model).collect()}
    assert np.mean([got[d] == (q == 1) for d, q in truth.items()]) > 0.95
    odd = spark.createDataFrame([(1, t) for t in TEXTS] + [(None, "x")], "doc_id long, text string").selectExpr("*", "1 AS key", "2 AS kept")
    rows = quality_rules.judge(odd, model).collect()
    assert len(rows) == len(TEXTS) + 1 and not any(r.kept for r in rows if r.base_failed)
    assert quality_rules.judge(odd.limit(0), model).collect() == []
    assert quality_rules.train(labels.filter("quality = 1"), docs) is None


def test_mil_hold_out_and_edges(spark, corpus):
    docs, labels = corpus
    model = quality_mil.train(labels, docs)
    truth = held(docs, labels)
    got = {r.doc_id: r.score for r in quality_mil.score(docs.select("doc_id", "text"), model).collect()}
    assert np.mean([(got[d] >= 0.5) == (q == 1) for d, q in truth.items()]) > 0.93
    odd = spark.createDataFrame([(1, t) for t in TEXTS], "doc_id long, text string").selectExpr("*", "1 AS key")
    rows = quality_mil.score(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len(TEXTS)
    assert len({r.score for r in rows if not r.text}) == 1
    assert quality_mil.score(odd.limit(0), model).collect() == []
    assert quality_mil.fit([np.zeros((1, quality_mil.SIZE))] * 3, np.ones(3)) is None


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, bag = rng.random((7, quality_mil.SIZE)), np.array([0, 0, 0, 1, 1, 2, 2])
    p = {k: v.astype(np.float64) for k, v in quality_mil._start().items()}
    dy = np.array([0.3, -1.0, 0.5])
    f = quality_mil._forward(p, x, bag, 3)
    g = quality_mil._gradients(p, x, bag, f, dy)
    for k in p:
        at = tuple(rng.integers(0, s) for s in p[k].shape)
        step = np.zeros_like(p[k])
        step[at] = 1e-6
        up, down = (quality_mil._forward(p | {k: p[k] + s}, x, bag, 3)["y"] @ dy for s in (step, -step))
        assert abs((up - down) / 2e-6 - g[k][at]) < 1e-5


def slow_score(text, model):
    """The score of one text, passage by passage, with plain sums."""
    words = (text or "").encode().split()
    h, e = [], []
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    at = 0
    for k in range(0, max(1, len(words)), quality_mil.PASSAGE_WORDS):
        own = words[k : k + quality_mil.PASSAGE_WORDS]
        x = np.zeros(quality_mil.SIZE)
        if own:
            # The passage's bytes as they stand in the text.
            data = (text or "").encode()
            begin = data.index(own[0], at)
            stop = begin
            for word in own:
                stop = data.index(word, stop) + len(word)
            at = stop
            piece = data[begin:stop]
            tri = [int(features.trigrams(np.frombuffer(piece[i : i + 3], np.uint8), quality_mil.BYTE_BITS)[0]) for i in range(len(piece) - 2)]
            for b in tri:
                x[b] += 1 / len(tri)
            hashes = np.array([features.hash_spans(np.frombuffer(v, np.uint8), np.array([0]), np.array([len(v)]))[0] for v in own], np.uint64)
            grams = [*hashes, *(features._SAME if own[i] == own[i + 1] else features.mix(np.array([hashes[i] * features._P + hashes[i + 1]]))[0] for i in range(len(own) - 1))]
            for g in grams:
                x[(1 << quality_mil.BYTE_BITS) + int(features.bucket(np.array([g]), quality_mil.WORD_BITS)[0])] += 1 / len(grams)
        h.append(np.tanh(quality_mil.SCALE * x @ w["W"] + w["c"]))
        e.append(float(sum(g * np.tanh(h[-1] @ v) / (1 + np.exp(-(h[-1] @ u))) for g, v, u in zip(w["g"], w["V"].T, w["U"].T, strict=True))))
    share = [np.exp(v - max(e)) for v in e]
    z = sum(s * x for s, x in zip(share, h, strict=True)) / sum(share)
    return 1 / (1 + np.exp(-(model.slope * (z @ w["o"] + w["b"][0]) + model.offset)))


@pytest.mark.filterwarnings("ignore:overflow")
def test_mil_scores_equal_a_slow_scorer(spark, corpus):
    docs, labels = corpus
    model = quality_mil.train(labels, docs)
    texts = [r.text for r in docs.orderBy("doc_id").collect()[::25]] + TEXTS
    got = quality_mil.score_slice(pa.array(texts, pa.string()), model)
    assert np.allclose(got, [slow_score(t, model) for t in texts], atol=1e-4)


def test_fitting_takes_every_passage_and_one_row_an_id(spark):
    long = " ".join(f"w{i}" for i in range(64 * 100 + 1))
    rows = [(1, long), (2, "a b"), (2, "a b"), (2, "c"), (3, None), (4, "x " * 64 * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS label", "2 AS key", "3 AS l_key")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 0), (4, 0), (9, 1), (None, 1)], "doc_id long, quality int")
    sample = features.labelled(labels, docs, "quality", 100)
    assert sorted((r.key, r.label) for r in sample.collect()) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    bags, label = quality_mil.collect_bags(sample)
    assert [len(b) for b in bags] == [101, 1, 1, 40] and label.tolist() == [1, 1, 0, 0]
    assert {r.key for r in quality_mil.drawn(sample, 8 * 40).collect()} == {2, 3, 4}
    assert {r.key for r in quality_mil.drawn(sample, 142 * 8).collect()} == {1, 2, 3, 4}
    assert features.labelled(labels, docs, "quality", 2).count() <= 2


def test_character_trigrams_are_code_points():
    raw, offsets = batches.flat(pa.array(["éaü", "", "aéa", "xéaüy", "\U0001f600b"]))
    points, places = features.code_points(raw, offsets)
    assert places.tolist() == [0, 3, 3, 6, 11, 13]
    tri = features.character_trigrams(points, 13)
    assert tri[0] == tri[7] and len(tri) == 11 and tri[0] != tri[3]


def test_passages_cover_the_text():
    raw, offsets = batches.flat(pa.array(["", "w " * 130, "é"]))
    x, bag = quality_mil.passages(raw, offsets)
    assert bag.tolist() == [0, 1, 1, 1, 2] and not x[0].any()
