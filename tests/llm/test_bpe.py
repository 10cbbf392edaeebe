import hashlib
import struct

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessel.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_path()
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
OWN = bpe.Tokenizer(bpe.load(PATH))


def encoded(texts):
    ids, offsets = OWN.encode_slice(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], ids, offsets


def expected(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


CASES = [
    "", None, " ", "  ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "\t\tx", "don't we'll I'd", "a\r\n\r\n  b", "x" * 500, "ab" * 3000,
    "  a b　", "a\n\n b", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "日本語 テキスト、です。", "é à ü ß", "👍🏽 ok", "\x1c\x1d a\x85b", "12345 6789", " " * 300, "​ x", "a\x00b", "'s 't''''re", "foo  bar", "ŉ ǅ Ⅷ ²",
]


def test_ids_and_round_trip_match_the_library():
    got, ids, offsets = encoded(CASES)
    assert got == expected(CASES)
    raw, ends = OWN.decode_slice(ids.astype(np.int64), offsets)
    back = [raw[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert back == [LIBRARY.decode(i, skip_special_tokens=False) for i in got]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text(" \n\tab'sé<|endoftext|>1 .", max_size=60), max_size=8))
def test_any_texts(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    got, ids, offsets = encoded(texts)
    assert got == expected(texts)


def test_cut_tokens_decode_as_in_the_library():
    whole = LIBRARY.encode("日本語", add_special_tokens=False).ids
    parts = [whole[:1], whole[1:], whole]
    flat = np.array(sum(parts, []), np.int64)
    raw, ends = OWN.decode_slice(flat, np.cumsum([0, *map(len, parts)]))
    assert [raw[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == [LIBRARY.decode(p, skip_special_tokens=False) for p in parts]


def test_long_tree_equals_short_trees():
    for text in (b"thethethe theth", b"aaaaaaaaaaaaaaaa", bytes(range(33, 90))):
        ids, counts = OWN.merge_short(np.frombuffer(text, np.uint8), np.array([0]), np.array([len(text)]))
        assert ids.tolist() == OWN.merge_long(text)


def test_query(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(3, "a\n\nb"), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS key")
    got = sorted(bpe.digests(docs, PATH).collect(), key=str)
    want = []
    for key, text in rows:
        ids = expected([text])[0]
        back = LIBRARY.decode(ids, skip_special_tokens=False)
        want.append((key, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert [tuple(r) for r in got] == sorted(want, key=lambda r: str(bpe_row(*r)))
    assert bpe.digests(docs.limit(0), PATH).collect() == []


def bpe_row(doc_id, n_tokens, ids_sha256, decoded_sha256):
    from pyspark.sql import Row

    return Row(doc_id=doc_id, n_tokens=n_tokens, ids_sha256=ids_sha256, decoded_sha256=decoded_sha256)
