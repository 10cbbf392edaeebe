import random
from array import array

import numpy as np
import pytest

from tessel.llm import graph, near_join
from tessel.llm.near_join import Rule


def brute(rows, rule):
    """Components by comparing every pair of word sets."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, text in rows:
        w = (text or "").translate(table).encode().split()
        sets.append({tuple(w[i : i + rule.words]) for i in range(len(w) - rule.words + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(least.get(x, i), i)
    return sorted((i, len(s), least[x]) for (i, _), s, x in zip(rows, sets, label, strict=True))


def corpus(seed, n=160, size=60, vocabulary=400):
    rng = random.Random(seed)
    texts = ["", None, " \n", "one", "ONE", "two words", "Two  words", "a b c", "A b\tc", "a b c d"]
    while len(texts) < n:
        words = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randrange(3, size))]
        for _ in range(rng.choice((1, 1, 2, 6, 14))):
            texts.append(" ".join(words))
            if rng.random() < 0.7:
                for _ in range(rng.choice((1, 1, 2, 3))):
                    words[rng.randrange(len(words))] = f"x{rng.randrange(90)}"
                if rng.random() < 0.3:
                    words += [f"y{rng.randrange(9)}"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(spark, rows, rule, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS n", "3 AS comp", "4 AS component")
    got = near_join.join(docs, rule, **options).collect()
    return sorted((r.id, r.n, r.component) for r in got)


@pytest.mark.parametrize(("rule", "seed"), [(Rule(), 1), (Rule(5, 4, 5), 2), (Rule(2, 2, 3), 3)])
def test_components_equal_brute_force(spark, rule, seed):
    rows = corpus(seed)
    assert result(spark, rows, rule) == brute(rows, rule)


def test_small_blocks_give_the_same(spark):
    rule, rows = Rule(3, 4, 5), corpus(7, n=150, vocabulary=60)
    chain = [f"c{i}" for i in range(60)]
    for k in range(40):  # a long chain of near copies whose ends don't link
        rows.append((1000 + k, " ".join(chain)))
        chain[k % 60] = f"d{k}"
    assert result(spark, rows, rule, block_docs=5) == brute(rows, rule)


def test_solve_and_search_against_brute_force(monkeypatch):
    rng = random.Random(3)
    for _ in range(200):
        lists = [array("i", sorted(rng.sample(range(30), rng.randrange(1, 20)))) for _ in range(rng.randrange(1, 25))]
        least = rng.randrange(1, len(lists) + 2)
        want = {d: c for d in range(30) if (c := sum(d in x for x in lists)) >= least}
        assert near_join.t_occurrence(lists, least) == want
        with monkeypatch.context() as patch:
            patch.setattr(near_join, "HEAP_ENTRIES", 0)
            assert near_join.t_occurrence(lists, least) == want
    rule = Rule(3, 7, 10)
    for _ in range(60):
        base = rng.sample(range(200), 20)
        sets = []
        for _ in range(25):
            base = [x if rng.random() > 0.06 else rng.randrange(200) for x in base]
            sets.append(np.array(sorted(set(base)), np.uint64))
        roots, _ = near_join.solve(sets, rule)
        rows = [(i, " ".join(map(str, s))) for i, s in enumerate(sets)]
        want = {}
        one = Rule(1, 7, 10)
        for (i, _, c) in brute(rows, one):
            want[i] = c
        assert roots == [want[i] for i in range(len(sets))]


def test_linked_sets_share_enough_signatures():
    rng = np.random.default_rng(5)
    for rule in (Rule(), Rule(5, 4, 5)):
        for _ in range(400):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 120)).astype(np.uint64))
            keep = a[rng.random(len(a)) > rng.random() * 0.2]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and rule.linked(both, len(a), len(b)) and not np.array_equal(a, b):
                of_a, of_b = ({c: (need, set(s.tolist())) for c, need, s in near_join.signatures(x, rule)} for x in (a, b))
                met = [c for c in of_a if c in of_b and len(of_a[c][1] & of_b[c][1]) >= max(of_a[c][0], of_b[c][0])]
                assert met


def test_linked_sets_share_enough_of_their_prefixes(spark):
    rng, pairs = np.random.default_rng(6), 0
    sizes = spark.range(1, 400).selectExpr("id AS n")
    for rule in (Rule(), Rule(5, 4, 5), Rule(2, 2, 3)):
        least = {r.n: r.least for r in sizes.select("n", rule.least_shared(sizes.n).alias("least")).collect()}
        for _ in range(600):
            a = np.unique(rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64))
            keep = a[rng.random(len(a)) > rng.random() * 0.4]
            b = np.unique(np.concatenate([keep, rng.integers(0, 2**63, rng.integers(0, 20)).astype(np.uint64)]))
            if len(b) and rule.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                met = len(np.intersect1d(a[: rule.prefix(len(a))], b[: rule.prefix(len(b))]))
                assert met >= max(least[len(a)], least[len(b)])
                pairs += 1
    assert pairs > 300


def test_prefix_counts_equal_brute_force(spark):
    rows, rule = corpus(11), Rule()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.node: r.hits / r.slices for r in near_join.shared_prefixes(docs, rule).collect()}
    import pyarrow as pa

    sets = {near_join.fingerprint(s): s for s in near_join.shingle_sets(pa.array([t for _, t in rows]), 3) if len(s)}
    heads = {near_join._node(p): set(s[: rule.prefix(len(s))].tolist()) for p, s in sets.items()}
    want = {k: sum(any(x in other for j, other in heads.items() if j != k) for x in own) for k, own in heads.items()}
    assert got == want and max(want.values()) > 3


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(3, 3), (50, 51), (51, 50)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in range(7, 30)}, 50: 50, 51: 50}
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_edges_of_the_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, ""), (5, None)]
    assert sorted(result_rows(spark, rows), key=str) == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 0, None), (5, 0, 5)], key=str)
    assert result_rows(spark, []) == []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r.doc_id for r in near_join.keep_one(docs, Rule()).collect()]
    assert sorted(kept, key=str) == sorted([None, None, 5], key=str)  # the null id sorts first in its component
    extra = spark.createDataFrame([(3, "p q r s"), (3, "t u v w"), (3, "t u v w"), (None, "k l m n")], "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in near_join.keep_one(extra, Rule()).collect()]
    assert sorted(kept, key=str) == sorted([(3, "p q r s"), (3, "t u v w"), (None, "k l m n")], key=str)


def result_rows(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.id, r.n, r.component) for r in near_join.join(docs, Rule()).collect()]


def test_narrow_tables_are_few_files(spark, monkeypatch):
    """Each file is a process for its permissions, so tables of few narrow rows aren't dealt over all shuffle partitions."""
    files, write = [], near_join.checkpoint

    def counted(df, rows=None):
        done = write(df, rows)
        if not {"text", "leader"} & set(df.columns):
            files.append(len(done.inputFiles()))
        return done

    monkeypatch.setattr(near_join, "checkpoint", counted)
    monkeypatch.setattr(graph, "checkpoint", counted)
    rows, rule = corpus(7, n=150, vocabulary=60), Rule(3, 4, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    names = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = sorted((r.id, r.n, r.component) for r in near_join.join(docs, rule).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(rows, rule) and len(files) > 10 and max(files) == 1, files
