"""Substring dedup: paragraphs that recur, exactly or nearly, within and across documents.

Lines. A paragraph is a line of a text with at least ``MIN_WORDS`` words. Its set of five-word shingles gives a fingerprint
and ``BANDS`` hashes, each over ``ROWS`` MinHash values: with 20 bands of 4 rows, two paragraphs of similarity 0.8 share a
band with probability 0.99997. Paragraphs of equal sets form one class and only classes are compared. Classes that collide
in a band get a star of edges; connected components of the stars are candidate groups, in which exact Jaccard similarity
is verified on whole paragraphs by the search of :mod:`tessel.llm.near_join` (leaders, bounded blocks, no pairs within a
group), and verified links are clustered by components. The first occurrence of a cluster stays, all others go.

Passages. What recurs inside a longer line, or over the edges of lines, is in no such paragraph. So a text, line breaks
counting as white space, is also cut into paragraphs by its content alone, wherever its lines end:

1. A MinHash slides over the text: of every run of ``PASSAGE`` words, the ``SHINGLE``-word shingle of least hash is its
   anchor. Neighbouring runs mostly share theirs, so an anchor comes every seven words or so. A content paragraph reaches
   from an anchor to the end of the next one, 13 to 26 words. An equal run of words has equal ones, whatever is around it.
2. Content paragraphs are equal if their words are (64-bit hashes of all words). Those that occur elsewhere than in
   overlapping places of one document recur; all but the first place go.
3. Recurring paragraphs that follow one another in a text share an anchor. Their chains of ``PASSAGE`` words or more are
   passages: as every paragraph of a chain recurs, so does what lies over the joints. Shorter chains, such as a common
   short line, are left alone.

Every recurring run of 2 * PASSAGE + 1 = 51 words thus yields a passage of at least 25 words: its first anchor starts
within 14 words of its beginning and its last one ends within 14 of its end. Of shorter runs many are found. A passage's
span may begin and end up to 13 words inside the run. A changed word parts a passage in two, each found if long enough.

How it scales: nothing of the corpus reaches the driver. Minima and maxima are combined before they are shuffled, and rows
of a common paragraph meet them in a join that adaptive execution can split; a band that many paragraphs of a slice of rows
have makes one row a slice. Only texts with candidates are read again, once each.

Defined cases: null and blank texts and shorter lines have no paragraph; a paragraph is as long as its line; equal lines
of one document cluster too; rows of equal id count as one document, so equal rows yield equal occurrences; null ids are
one document; an empty table gives an empty result; extra columns do no harm. Ids must be integers or castable to them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import batches, features, near_join
from tessel.session import checkpoint, release
from tessel.sources.tables import table

MIN_WORDS = 25
BANDS, ROWS = 20, 4
RULE = near_join.Rule(words=5, num=4, den=5)
PASSAGE = 25
SHINGLE = 12

_rng = np.random.default_rng(11)
_SCALE = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFT = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _lines(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document, number within the document) of every line, in bytes."""
    breaks = np.flatnonzero(raw == 10)
    n = len(offsets) - 1
    starts, ends = np.concatenate([offsets[:-1], breaks + 1]), np.concatenate([breaks, offsets[1:]])
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    doc = np.concatenate([np.arange(n), owner])
    order = np.lexsort((np.concatenate([np.zeros(n, int), np.ones(len(breaks), int)]), starts, doc))
    end_order = np.lexsort((np.concatenate([np.zeros(len(breaks), int), np.ones(n, int)]), ends, np.concatenate([owner, np.arange(n)])))
    doc = doc[order]
    first = np.searchsorted(doc, np.arange(n))
    return starts[order], ends[end_order], doc, np.arange(len(doc)) - first[doc]


def minhash_bands(grams: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """[paragraph, band] hashes; ``begin`` is where each paragraph's shingle hashes start."""
    out = np.zeros((len(begin), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(begin), np.uint64(band + 1), np.uint64)
        for row in range(band * ROWS, (band + 1) * ROWS):
            low = np.minimum.reduceat((grams * _SCALE[row] + _SHIFT[row]) >> np.uint64(16), begin)
            h = features.mix(h * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = h
    return out


def occurrences_slice(texts: pa.Array, min_words: int, with_bands: bool = False) -> dict[str, np.ndarray]:
    """The paragraphs of a slice: row, number, span in code points, words, set size, node, and bands if wanted."""
    raw, offsets = batches.flat(texts)
    starts, ends, doc, number = _lines(raw, offsets)
    w_start, w_end, _ = batches.words(raw, offsets)
    line = np.searchsorted(starts, w_start, side="right") - 1 if len(starts) else np.zeros(0, np.int64)
    count = np.bincount(line, minlength=len(starts))
    kept = np.flatnonzero(count >= max(min_words, RULE.words))
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    base = points[offsets[:-1]][doc[kept]]
    out = {"row": doc[kept], "paragraph": number[kept], "start": points[starts[kept]] - base, "end": points[ends[kept]] - base, "n_words": count[kept]}
    out |= {"n": np.zeros(0, np.int64), "node": np.zeros(0, np.int64), "bands": np.zeros((0, BANDS), np.uint64)}
    if not len(kept):
        return out
    _, h = features.word_hashes(near_join._LOWER[raw], w_start, w_end)
    first = (np.cumsum(count) - count)[kept]
    size = len(h) - RULE.words + 1
    grams = h[:size].copy()
    for k in range(1, RULE.words):
        grams = features.mix(grams * _BASE + h[k : size + k])
    lengths = count[kept] - RULE.words + 1
    own = grams[batches.ragged(first, lengths)]
    owner = np.repeat(np.arange(len(kept)), lengths)
    order = np.lexsort((own, owner))
    held, of = own[order], owner[order]
    distinct = np.concatenate([[True], (held[1:] != held[:-1]) | (of[1:] != of[:-1])])
    held, of = held[distinct], of[distinct]
    out["n"] = np.bincount(of, minlength=len(kept))
    # As near_join.fingerprint does, of which it is the first half.
    out["node"] = np.add.reduceat(features.mix(held), np.searchsorted(of, np.arange(len(kept)))).view(np.int64)
    if with_bands:
        out["bands"] = minhash_bands(own, np.cumsum(lengths) - lengths)
    return out


def _own(key: str, text: str):
    return F.xxhash64(F.col(key).cast("bigint"), F.col(text))


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(own, doc, paragraph, start, end, n_words, n, node) of every paragraph; own is a hash of id and text, node one of its
    set of shingles."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                got = occurrences_slice(part.column("text"), min_words)
                numbers = [pa.array(np.asarray(got[c], np.int64)) for c in ("paragraph", "start", "end", "n_words", "n", "node")]
                columns = [*(part.column(c).take(pa.array(got["row"])) for c in ("own", "doc")), *numbers]
                yield pa.RecordBatch.from_arrays(columns, names=["own", "doc", "paragraph", "start", "end", "n_words", "n", "node"])

    chosen = docs.select(_own(key, text).alias("own"), F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    return chosen.transform(batches.bounded).mapInArrow(run, "own bigint, doc bigint, paragraph bigint, start bigint, end bigint, n_words bigint, n bigint, node bigint")


def band_rows(nodes: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, key) rows of a slice's paragraphs. Of those that share a band the least gives a row with that band as key;
    each other one is joined to it by two rows with a key of their own, once for all bands they share."""
    distinct, first = np.unique(nodes, return_index=True)
    flat = bands[first].ravel()
    order = np.argsort(flat, kind="stable")
    owner = order // BANDS
    sign = flat[order]
    head = np.concatenate([[True], sign[1:] != sign[:-1]])[: len(sign)]
    least = owner[head][np.cumsum(head) - 1] if len(sign) else owner
    pairs = np.unique(np.stack([owner[~head], least[~head]]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    one, other = distinct[pairs[0]], distinct[pairs[1]]
    key = features.mix(features.mix(one.view(np.uint64)) * _BASE + other.view(np.uint64))
    return np.concatenate([distinct[owner[head]], one, other]), np.concatenate([sign[head], key, key]).view(np.int64)


def banded(docs: DataFrame, text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(node, key) of the paragraphs of each slice of rows: :func:`band_rows`."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                got = occurrences_slice(part.column("text"), min_words, with_bands=True)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in band_rows(got["node"], got["bands"])], names=["node", "key"])

    return docs.select(F.col(text).alias("text")).transform(batches.bounded).mapInArrow(run, "node bigint, key bigint")


def _signs(texts: DataFrame) -> DataFrame:
    """Bands of paragraphs (id, text) in the form that near_join.links takes."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                got = occurrences_slice(part.column("text"), 0, with_bands=True)
                nodes = part.column("id").take(pa.array(got["row"]))
                yield pa.RecordBatch.from_arrays([nodes.take(pa.array(np.repeat(np.arange(len(nodes)), BANDS))), pa.array(got["bands"].ravel().view(np.int64))], names=["node", "sign"])

    found = texts.select("id", "text").transform(batches.bounded).mapInArrow(run, "node bigint, sign bigint")
    return found.select("node", F.lit(0).alias("class"), F.lit(1).alias("need"), "sign").distinct()


def _paragraph_texts(near: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text) of the paragraph (doc, paragraph, own) that each row (id, first) of ``near`` names. A document's text is
    carried once for all of them."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                ids, lines = [], []
                for whole, wanted in zip(part.column("text").to_pylist(), part.column("wanted").to_pylist(), strict=True):
                    own = whole.split("\n")
                    ids += [w["id"] for w in wanted]
                    lines += [own[w["paragraph"]] for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lines, pa.string())], names=["id", "text"])

    wanted = near.groupBy(F.col("first.own").alias("w_own")).agg(F.collect_list(F.struct("id", F.col("first.paragraph").alias("paragraph"))).alias("wanted"))
    joined = docs.select(_own(key, text).alias("own"), F.col(text).alias("text")).join(wanted, F.col("own") == F.col("w_own")).select("text", "wanted")
    return joined.transform(batches.bounded).mapInArrow(run, "id bigint, text string").dropDuplicates(["id"])


def clusters(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, block_docs: int = near_join.BLOCK_DOCS) -> DataFrame:
    """(own, doc, paragraph, start, end, n_words, cluster_doc, cluster_paragraph, removed) of every line that recurs.

    (cluster_doc, cluster_paragraph) is the cluster's first occurrence, the one that stays.
    """
    found = checkpoint(occurrences(docs, key, text, min_words))
    first = F.min(F.struct("doc", "paragraph", "own")).alias("first")
    narrow = checkpoint(found.groupBy("node").agg(first, F.count("*").alias("rows"), F.max("n").alias("n")))
    # Bands are made in a pass of their own: reading the texts twice costs less than keeping all bands on disk.
    least = F.min("node").over(Window.partitionBy("key"))
    stars = checkpoint(banded(docs, text, min_words).withColumn("least", least).filter("node != least").select("node", "least").distinct())
    groups = near_join.groups_of(stars).select(F.col("id").alias("g_id"), F.col("component").alias("comp"))
    near = checkpoint(narrow.join(groups, F.col("node") == F.col("g_id")).select(F.col("node").alias("id"), "n", "comp", "first"))
    texts = checkpoint(_paragraph_texts(near, docs, key, text))
    labels = checkpoint(near_join.links(near.drop("first"), texts, _signs(texts), RULE, block_docs).select(F.col("id").alias("l_id"), "label"))
    release(stars, near, texts)
    named = narrow.join(labels, F.col("node") == F.col("l_id"), "left").withColumn("label", F.coalesce("label", "node"))
    sums = named.groupBy(F.col("label").alias("s_label")).agg(F.sum("rows").alias("total"), F.min("first").alias("origin")).filter("total > 1")
    members = named.join(sums, F.col("label") == F.col("s_label")).select(F.col("node").alias("m_node"), "origin")
    rows = found.drop("n").join(members, F.col("node") == F.col("m_node"))
    removed = ~(F.col("doc").eqNullSafe(F.col("origin.doc")) & (F.col("paragraph") == F.col("origin.paragraph")))
    return rows.select("own", "doc", "paragraph", "start", "end", "n_words", F.col("origin.doc").alias("cluster_doc"), F.col("origin.paragraph").alias("cluster_paragraph"), removed.alias("removed"))


def _runs(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of every run of ``words`` word hashes, by prefix sums."""
    at = np.arange(max(0, len(h) - words + 1))
    return _span_hashes(h, at, at + words)


def _span_hashes(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words begin to end (exclusive) of each span, the same wherever it stands."""
    powers, back = np.full(len(h) + 1, _BASE), np.full(len(h) + 1, _INVERSE)
    powers[0] = back[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(powers)[: len(h)])])
    return features.mix((sums[end] - sums[begin]) * np.cumprod(back)[begin])


_CONTENT = ("row", "pos", "next", "line", "start", "cut", "stop", "unit")


def content_paragraphs(texts: pa.Array, words: int = PASSAGE, shingle: int = SHINGLE) -> dict[str, np.ndarray]:
    """The content paragraphs of a slice: row, the word numbers pos of its anchor and next of the one it ends with, the
    line it begins in, its start and stop in code points, cut, the end of the last word before the next anchor, and unit,
    the hash of its words. A run's anchor is its last shingle of least hash."""
    raw, offsets = batches.flat(texts)
    starts, ends, doc = batches.words(raw, offsets)
    _, h = features.word_hashes(near_join._LOWER[raw], starts, ends)
    size, wide = len(h) - words + 1, words - shingle + 1
    runs = np.flatnonzero(doc[: max(0, size)] == doc[words - 1 :][: max(0, size)])
    if not len(runs):
        return dict.fromkeys(_CONTENT, np.zeros(0, np.int64))
    least = np.lib.stride_tricks.sliding_window_view(_runs(h, shingle), wide)[:, ::-1].argmin(axis=1)
    # Neighbouring runs of one text have one anchor or ascending ones.
    at = np.unique(runs + wide - 1 - least[runs])
    here, after = at[:-1], at[1:]
    inside = doc[here] == doc[after]
    here, after = here[inside], after[inside]
    row = doc[here]
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))[row]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    base = offsets[row]
    places = (here - first, after - first, breaks[starts[here]] - breaks[base], points[starts[here]] - points[base], points[ends[after - 1]] - points[base], points[ends[after + shingle - 1]] - points[base])
    return dict(zip(_CONTENT, (row, *places, _span_hashes(h, here, after + shingle).view(np.int64)), strict=True))


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = PASSAGE, shingle: int = SHINGLE) -> DataFrame:
    """(own, doc, paragraph, start, end, n_words, cluster_doc, cluster_paragraph, removed) of every passage that recurs.

    own is a hash of id and text; paragraph is the line it begins in; (cluster_doc, cluster_paragraph) is where its first
    content paragraph occurs first. A passage of which a part stays and a part goes makes a row for each.
    """

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                got = content_paragraphs(part.column("text"), words, shingle)
                taken = [part.column(c).take(pa.array(got["row"])) for c in ("row", "own", "doc")]
                yield pa.RecordBatch.from_arrays([*taken, *[pa.array(got[c].astype(np.int32)) for c in _CONTENT[1:-1]], pa.array(got["unit"])], names=["row", "own", "doc", *_CONTENT[1:]])

    chosen = docs.select(F.monotonically_increasing_id().alias("row"), _own(key, text).alias("own"), F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    made = checkpoint(chosen.transform(batches.bounded).mapInArrow(run, "row bigint, own bigint, doc bigint, pos int, next int, line int, start int, cut int, stop int, unit bigint"))
    ends = made.groupBy(F.col("unit").alias("e_unit")).agg(F.min(F.struct("doc", "pos", "line")).alias("first"), F.max("doc").alias("last_doc"), F.max("pos").alias("last_pos"))
    # A written table: its shuffle is gone before the next one, and the join below is one of two plain exchanges.
    ends = checkpoint(ends.filter(~F.col("first.doc").eqNullSafe(F.col("last_doc")) | (F.col("last_pos") - F.col("first.pos") >= words)))
    gone = ~(F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("pos") - F.col("first.pos") < words))
    met = made.join(ends, F.col("unit") == F.col("e_unit")).select("row", "own", "doc", "pos", "next", "line", "start", "cut", "stop", F.col("first.doc").alias("f_doc"), F.col("first.line").alias("f_line"), gone.alias("removed"))
    kept = checkpoint(met)
    release(made, ends)
    # Chains, and their parts that stay or go; each has its paragraphs up to their next anchors, the last one its end.
    order = Window.partitionBy("row").orderBy("pos")
    joint = F.lag("next").over(order).eqNullSafe(F.col("pos"))
    turned = ~joint | (F.lag("removed").over(order) != F.col("removed"))
    numbered = kept.withColumns({"fresh": (~joint).cast("int"), "turned": turned.cast("int"), "more": F.lead("pos").over(order).eqNullSafe(F.col("next"))})
    numbered = numbered.withColumns({"chain": F.sum("fresh").over(order), "part": F.sum("turned").over(order)})
    length = F.max(F.col("next") + shingle).over(Window.partitionBy("row", "chain")) - F.min("pos").over(Window.partitionBy("row", "chain"))
    final = numbered.withColumn("length", length).filter(F.col("length") >= words)
    tail = F.struct("pos", F.when(F.col("more"), F.col("next")).otherwise(F.col("next") + shingle).alias("last"), F.when(F.col("more"), F.col("cut")).otherwise(F.col("stop")).alias("stop"))
    parts = final.groupBy("row", "own", "doc", "part", "removed").agg(F.min(F.struct("pos", "line", "start", "f_doc", "f_line")).alias("a"), F.max(tail).alias("z"))
    long = lambda c: F.col(c).cast("bigint")
    n_words = (F.col("z.last") - F.col("a.pos")).cast("bigint")
    return parts.select("own", "doc", long("a.line").alias("paragraph"), long("a.start").alias("start"), long("z.stop").alias("end"), n_words.alias("n_words"), F.col("a.f_doc").alias("cluster_doc"), long("a.f_line").alias("cluster_paragraph"), "removed")


def recurring(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole lines that recur and passages that recur, in one table; a line that recurs exactly may be in both."""
    found = checkpoint(passages(docs, key, text))
    return clusters(docs, key, text).unionByName(found).drop("own")


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns kept, without the paragraphs and passages that go. The line breaks of paragraphs
    go with them, and so do those of lines of which a passage leaves only blanks."""
    gone = clusters(docs, key, text, **options).filter("removed").groupBy(F.col("own").alias("g_own")).agg(F.collect_set("paragraph").alias("g_gone"))
    cuts = passages(docs, key, text).filter("removed").groupBy(F.col("own").alias("c_own")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("c_cuts"))
    work = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _own(key, text).alias("own"))
    joined = work.join(gone, F.col("own") == F.col("g_own"), "left").join(cuts, F.col("own") == F.col("c_own"), "left")
    cut = F.when(F.col("g_gone").isNull() & F.col("c_cuts").isNull(), F.col("row")[text]).otherwise(_without(F.col("row")[text], F.col("g_gone"), F.col("c_cuts.start"), F.col("c_cuts.end")))
    return joined.select(*[(cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def without(text: str, gone: set[int], cuts: list[tuple[int, int]]) -> str:
    """``text`` without the lines ``gone`` and the ascending spans ``cuts``."""
    kept, at, next_cut = [], 0, 0
    for k, line in enumerate(text.split("\n")):
        stop, parts, begin = at + len(line), [], at
        while next_cut < len(cuts) and cuts[next_cut][1] <= at:
            next_cut += 1
        i = next_cut
        while i < len(cuts) and cuts[i][0] < stop:
            parts.append(text[begin : max(begin, cuts[i][0])])
            begin = max(begin, cuts[i][1])
            i += 1
        left = "".join([*parts, text[begin:stop]]) if parts else line
        if k not in gone and (left.strip() or not parts):
            kept.append(left)
        at = stop + 1
    return "\n".join(kept)


def _without(text, gone, starts, ends):
    @F.pandas_udf("string")
    def run(texts: pd.Series, gone: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        some = lambda x: [] if x is None else x
        rows = zip(texts, gone, starts, ends, strict=True)
        return pd.Series([t if t is None else without(t, set(some(g)), list(zip(some(s), some(e), strict=True))) for t, g, s, e in rows], dtype=object)

    return run(text, gone, starts, ends)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = recurring(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"doc": "doc_id", "cluster_doc": "cluster_doc_id"})
