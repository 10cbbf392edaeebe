import itertools
import random
import re

import numpy as np
import pyarrow as pa

from tessel.llm import features, near_join, paragraph_dedup


def brute(rows, min_words):
    """Clusters by comparing every pair of paragraphs."""
    found = []
    for doc, text in rows:
        at = 0
        for k, line in enumerate((text or "").split("\n")):
            w = line.lower().encode().split()
            if len(w) >= min_words:
                found.append(((doc, k), at, at + len(line), len(w), {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
            at += len(line) + 1
    label = list(range(len(found)))
    for i, a in enumerate(found):
        for j, b in enumerate(found[:i]):
            if 5 * len(a[4] & b[4]) >= 4 * len(a[4] | b[4]):
                x, y = label[i], label[j]
                label = [y if z == x else z for z in label]
    out = []
    for i, a in enumerate(found):
        own = [found[j][0] for j in range(len(found)) if label[j] == label[i]]
        if len(own) > 1:
            out.append((*a[0], a[1], a[2], a[3], *min(own), a[0] != min(own)))
    return sorted(out)


def corpus(seed, n=40):
    rng = random.Random(seed)
    stock = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(8, 70))] for _ in range(25)]
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "é ü " * 20 + "\n\n" + "é ü " * 20)]
    for doc in range(10, n):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(stock)) if rng.random() < 0.6 else [f"u{rng.randrange(9999)}é" for _ in range(rng.randrange(1, 40))]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = f"X{rng.randrange(50)}"
            lines.append(" ".join(words))
        rows.append((doc, "\n".join(lines)))
    return rows


def result(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS node", "3 AS paragraph")
    return sorted(tuple(r) for r in paragraph_dedup.clusters(docs, **options).drop("own").collect())


def test_clusters_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert result(spark, rows, min_words=10) == brute(rows, 10)
    assert result(spark, rows, min_words=10, block_docs=3) == brute(rows, 10)


def test_edges(spark):
    assert result(spark, []) == [] and result(spark, [(1, None), (2, "a b c")]) == []
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(5, f"a\n{line}\nb"), (6, line), (6, line)]
    got = result(spark, rows)
    assert got == [(5, 1, 2, 2 + len(line), 60, 5, 1, False), (6, 0, 0, len(line), 60, 5, 1, True), (6, 0, 0, len(line), 60, 5, 1, True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS row")
    assert sorted((r.doc_id, r.text) for r in paragraph_dedup.strip(docs).collect()) == [(5, f"a\n{line}\nb"), (6, ""), (6, "")]


def test_recall_of_the_bands():
    rng, hits, total = np.random.default_rng(1), 0, 300
    for _ in range(total):
        a = rng.integers(0, 1 << 63, 90).astype(np.uint64)
        b = np.concatenate([a[:80], rng.integers(0, 1 << 63, 10).astype(np.uint64)])  # similarity 0.8
        bands = paragraph_dedup.minhash_bands(np.concatenate([a, b]), np.array([0, 90]))
        hits += bool((bands[0] == bands[1]).any())
    assert hits >= total - 1


def test_lines_of_a_slice():
    got = paragraph_dedup.occurrences_slice(pa.array(["", None, "\n", "a\n" + "b " * 6, "c " * 7 + "\n" + "d " * 8 + "\n"]), 5)
    assert list(zip(got["row"], got["paragraph"], got["start"], got["end"], got["n_words"], strict=True)) == [(3, 1, 2, 14, 6), (4, 0, 0, 14, 7), (4, 1, 15, 31, 8)]
    assert near_join.fingerprint(np.array([1], np.uint64)) != near_join.fingerprint(np.array([2], np.uint64))


BASE, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def mixed(h):
    h = ((h ^ (h >> 29)) * 0xC2B2AE3D27D4EB4F) & ALL
    return h ^ (h >> 32)


def brute_anchors(words, n, shingle):
    """The last shingle of least hash of every run of n words, each hash summed up by itself."""
    h = [int(features.hash_spans(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())]))[0]) for w in words]
    grams = [mixed(sum(x * pow(BASE, j, 1 << 64) for j, x in enumerate(h[i : i + shingle])) & ALL) for i in range(len(h) - shingle + 1)]
    return sorted({min(range(r, r + n - shingle + 1), key=lambda i: (grams[i], -i)) for r in range(len(h) - n + 1)})


def brute_passages(rows, n, shingle):
    """Passages by comparing the words of all content paragraphs."""
    seen, texts = {}, []
    key = lambda doc: (doc is not None, doc)
    for doc, text in rows:
        words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(r"[^ \t-\r]+", text or "")]
        at = brute_anchors([w[2] for w in words], n, shingle)
        units = [(a, b, tuple(w[2] for w in words[a : b + shingle])) for a, b in zip(at, at[1:], strict=False)]
        texts.append((doc, text, words, units))
        for a, _, unit in units:
            seen.setdefault(unit, []).append((*key(doc), a, text.count("\n", 0, words[a][0])))
    out = []
    for doc, text, words, units in texts:
        chains = []
        for a, b, unit in units:
            places = seen[unit]
            first = min(places)
            if {p[:2] for p in places} == {first[:2]} and max(p[2] for p in places) - first[2] < n:
                continue
            gone = not (key(doc) == first[:2] and a - first[2] < n)
            if not (chains and chains[-1][-1][1] == a):
                chains.append([])
            chains[-1].append((a, b, gone, first))
        for chain in chains:
            if chain[-1][1] + shingle - chain[0][0] < n:
                continue
            for gone, part in itertools.groupby(chain, key=lambda x: x[2]):
                part = list(part)
                last = part[-1][1] + (shingle if part[-1] is chain[-1] else 0)
                begin = words[part[0][0]][0]
                out.append((doc, text.count("\n", 0, begin), begin, words[last - 1][1], last - part[0][0], part[0][3][1], part[0][3][3], gone))
    return sorted(out, key=str)


def test_passages_equal_brute_force(spark):
    rng = random.Random(5)
    stock = [[f"w{rng.randrange(40)}é" for _ in range(rng.randrange(6, 60))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "é ü " * 60), (2, "é ü " * 60), (3, "a " * 70), (None, " ".join(stock[0] * 3)), (None, "x " + " ".join(stock[0] * 2))]
    for doc in range(10, 40):
        words = []
        for _ in range(rng.randrange(1, 6)):
            words += rng.choice(stock) if rng.random() < 0.6 else [f"U{rng.randrange(9999)}" for _ in range(rng.randrange(1, 50))]
        rows.append((doc, "".join(w + rng.choice([" ", " ", " ", "  ", "\n"]) for w in words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS pos", "3 AS unit")
    for n, shingle in ((10, 5), (25, 12)):
        got = sorted((tuple(r) for r in paragraph_dedup.passages(docs, words=n, shingle=shingle).drop("own").collect()), key=str)
        assert got == brute_passages(rows, n, shingle) and len(got) > 20


def test_planted_passages_of_51_words_are_all_caught(spark):
    """Passages of 51 words in two places each, inside long lines and over the edges of short ones, among clean texts."""
    rng = random.Random(8)
    rows, planted, n = [], {}, 0
    fill = lambda k: [f"f{rng.randrange(10**9)}" for _ in range(k)]
    for k in range(150):
        passage = fill(51)
        for _ in range(2):
            before, n = fill(rng.randrange(40)), n + 1
            words = before + passage + fill(rng.randrange(40))
            rows.append((n, "".join(w + rng.choice([" ", " ", " ", "\n" if k % 2 else " "]) for w in words)))
            planted[n] = (len(" ".join(before)), passage)
    common = fill(18)  # a short line that many documents share is no passage
    clean = {1000 + k for k in range(100)}
    rows += [(k, " ".join(fill(60)) + "\n" + " ".join(common) + "\n" + " ".join(fill(60))) for k in sorted(clean)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = paragraph_dedup.recurring(docs).collect()
    caught = {r.doc for r in got}
    assert caught == set(planted)
    texts = dict(rows)
    for r in got:
        words = texts[r.doc][r.start : r.end].split()
        assert len(words) == r.n_words >= 25 and set(words) <= set(planted[r.doc][1])
    assert {r.doc for r in got if r.removed} == {d for d in planted if d % 2 == 0}


def test_passage_inside_a_long_line_and_over_short_lines(spark):
    """Words that recur in no line of their own are found, and go where they occur again."""
    planted = [f"p{i}" for i in range(51)]
    fill = lambda c, n: [f"{c}{i}" for i in range(n)]
    long_line = " ".join(fill("a", 80) + planted + fill("b", 40))
    short_lines = "\n".join(" ".join((fill("c", 7) + planted + fill("d", 3))[i : i + 10]) for i in range(0, 61, 10))
    other = " ".join(fill("e", 60))
    docs = spark.createDataFrame([(1, long_line), (2, short_lines), (3, other)], "doc_id long, text string")
    one, two = sorted(paragraph_dedup.recurring(docs).collect())
    assert (one.doc, one.cluster_doc, one.removed, two.doc, two.cluster_doc, two.removed) == (1, 1, False, 2, 1, True)
    assert long_line[one.start : one.end].split() == short_lines[two.start : two.end].split() and one.n_words >= 25
    kept = {r.doc_id: r.text for r in paragraph_dedup.strip(docs).collect()}
    assert kept[1] == long_line and kept[3] == other
    assert kept[2].split() == (short_lines[: two.start] + " " + short_lines[two.end :]).split()
