"""The pipeline's stages against brute-force versions on a small table."""

import hashlib
import struct

import pytest

import corpus_pipeline
from tessel.llm import bpe, near_join, pii, quality_mil

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{FOLDER}/documents.parquet")
    out["documents"] = docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_columns(made):
    want = made["documents"].columns
    assert [made[n].columns == want for n, _ in corpus_pipeline.STAGES] == [True] * 4 + [False]


def test_quality_stage(spark, made):
    model = quality_mil.train(spark.read.parquet(f"{FOLDER}/labels.parquet"), made["documents"])
    import pyarrow as pa

    rows = made["documents"].collect()
    kept = {r.doc_id for r, s in zip(rows, quality_mil.score_slice(pa.array([r.text for r in rows]), model), strict=True) if s >= 0.5}
    assert kept == {r.doc_id for r in made["quality"].collect()}


def test_near_duplicate_stage(made):
    rows = sorted((r.doc_id, r.text) for r in made["quality"].collect())
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = t.translate(table).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if x == a else x for x in root]
    assert {rows[x][0] for x in root} == {r.doc_id for r in made["near_duplicates"].collect()}
    assert corpus_pipeline.NEAR == near_join.Rule(5, 4, 5)


def test_pii_stage(made):
    before = {r.doc_id: r.text for r in made["near_duplicates"].collect()}
    for r in made["pii"].collect():
        assert r.text == pii.redact_text(before[r.doc_id], pii.detect(before[r.doc_id])[1]) and r.n_chars == len(r.text)


def test_mixing_stage(made):
    words = lambda rows: sum(len(r.text.encode().split()) for r in rows)
    before, after = made["pii"].collect(), made["mixing"].collect()
    assert abs(words(after) - 1.5 * words(before)) < 40
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id].startswith(r.text) for r in after) and sum(texts[r.doc_id] != r.text for r in after) <= 40


def test_token_stage(made):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    want = []
    for r in made["mixing"].collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((r.doc_id, len(ids), packed, hashlib.sha256(packed).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, bytes(r.ids), r.ids_sha256, r.decoded_sha256) for r in made["tokens"].collect()]
    assert sorted(got) == sorted(want)


def test_run(spark, made):
    assert sorted(corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_sha256").collect()) == sorted(made["tokens"].select("doc_id", "ids_sha256").collect())


def edge_rows():
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    texts = [None, "", " \n\t", "one", "one", "a@b.cd wrote", "é ü ß " * 20, "one two three four five six", "one two three four five six", long, long + " end"]
    rows = [(i, t, "en", "src0" if i % 2 else None) for i, t in enumerate(texts)]
    return [*rows, rows[7], rows[9], (None, "null id with some words here", "en", "src1"), (None, None, None, None), (3, "another text of id three", "de", "src1")]


def edge_docs(spark):
    docs = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string")
    names = ["row", "size", "score", "Score_", "id", "own", "mark", "key", "label", "place", "n_tokens", "ids", "words"]
    return docs.selectExpr("*", "cast(length(text) as long) AS n_chars", *[f"{k} AS `{n}`" for k, n in enumerate(names)])


def plain(rows, *columns):
    return sorted(str([r[c] for c in columns]) for r in rows)


def test_stages_on_edge_rows(spark):
    import pyarrow as pa

    docs = edge_docs(spark)
    rows = docs.collect()
    # quality
    model = quality_mil.train(spark.read.parquet(f"{FOLDER}/labels.parquet"), docs)
    score = quality_mil.score_slice(pa.array([r.text for r in rows], pa.string()), model)
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    assert kept.columns == docs.columns and plain(kept.collect(), "doc_id", "text", "size") == plain([r for r, s in zip(rows, score, strict=True) if s >= 0.5], "doc_id", "text", "size")
    # near duplicates: long texts and those of six words are copies, "one" comes twice, blank ones all stay
    kept = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    want = [r for r in rows if r.doc_id in (0, 1, 2, 3, 5, 6, 7, 9, None)]
    seen, first = set(), []
    for r in want:
        if not (r.text or "").strip() or (r.doc_id, r.text) not in seen:
            first.append(r)
        seen.add((r.doc_id, r.text))
    assert plain(kept.collect(), "doc_id", "text", "label") == plain(first, "doc_id", "text", "label")
    # personal data
    got = corpus_pipeline.personal_data(spark, docs, FOLDER)
    assert got.columns == docs.columns
    redacted = [None if r.text is None else r.text.replace("a@b.cd", "<email>") for r in rows]
    assert sorted(map(str, ((r.doc_id, r.text, r.n_chars) for r in got.collect()))) == sorted(map(str, ((r.doc_id, t, None if t is None else len(t)) for r, t in zip(rows, redacted, strict=True))))
    # mixing
    got = corpus_pipeline.mixing(spark, docs, FOLDER)
    made = got.collect()
    words = sum(len((r.text or "").encode().split()) for r in rows)
    assert got.columns == docs.columns and abs(sum(len(r.text.encode().split()) for r in made) - 1.5 * words) < 4
    assert all(r.text.strip() and any((q.text or "").startswith(r.text) and q.doc_id == r.doc_id for q in rows) for r in made)
    # tokens
    got = {str((r.doc_id, r.n_tokens, r.decoded_sha256)) for r in corpus_pipeline.tokens(spark, docs, FOLDER).collect()}
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.default_path())
    assert got == {str((r.doc_id, len(library.encode(r.text or "", add_special_tokens=False).ids), hashlib.sha256((r.text or "").encode()).hexdigest())) for r in rows}


def test_stages_on_an_empty_table(spark):
    docs = edge_docs(spark).limit(0)
    assert [stage(spark, docs, FOLDER).count() for _, stage in corpus_pipeline.STAGES] == [0] * 5


def test_tokens_take_one_worker_a_task(spark):
    """Workers stay in an executor's memory beside those of later stages, so a task of tokens has one."""
    texts = ["", None, "one two", "é" * 400 + " \n\t x", "<|endoftext|> 12", "word " * 9000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = corpus_pipeline.tokens(spark, docs, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    path = bpe.default_path()
    want = {r.doc_id: (bytes(r.ids), r.text) for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for r in got.collect():
        ids, text = want[r.doc_id]
        assert (r.n_tokens, bytes(r.ids), r.decoded_sha256) == (len(ids) // 4, ids, hashlib.sha256(text.encode()).hexdigest())
