"""N-gram Jaccard self-join: components of documents whose shingle sets overlap enough, by T-occurrence search.

1. Profile: each text becomes its set of word n-gram hashes (64 bits), its size, and a fingerprint of the set. Documents
   of equal sets form one class; only a class's representative, its least id, goes on, so copies are never paired.
2. Prefixes, without loss: of the least hashes of a set, a tenth of its size more than a link may lack, linked sets have
   at least a share in common. A set whose prefix shares fewer with all others together goes, so all but copies and near
   copies are gone after one narrow shuffle. The survivors' texts are shuffled once and kept.
3. Blocking, without loss: two sets of sizes a and b that reach similarity t differ in at most (a + b)(1 - t) / (1 + t)
   elements. Elements are dealt by hash into more parts than that, so linked sets have equal parts. The hash of each part
   is a signature; survivors that share a signature get a star of edges to the least of them, and connected components
   of the stars are candidate groups. A link never leaves its candidate group.
4. Search: within a group, every document asks the inverted index of the group's leaders for documents that reach the
   required overlap T: DivideSkip merges the short lists with a heap (many entries as sorted runs), takes what occurs at
   least T - L times there, and counts it on in the L long lists by binary search. A document that links to no leader
   becomes one. Leaders that are close enough for their followers to link (triangle inequality of the Jaccard distance)
   have their followers searched too, until their components meet or every possibility is exhausted. So components are
   exact, yet a group of n near copies costs about n searches among few leaders, not n * n.
5. In a candidate group beyond ``BLOCK_DOCS`` or ``BLOCK_SHINGLES``, sets drop out that share too few of their elements
   with all others together. A group that is still that large is dealt into blocks, each solved by itself; leaders of
   blocks are solved again level by level; what then is outside a group's largest component is searched against those
   blocks that have enough of its signatures, in chunks. Tasks thus hold bounded blocks even where one group of near
   copies has a third of all rows.

Tasks read the texts of survivors alone and rebuild their sets; nothing of the corpus reaches the driver. Every step
writes its table to the shared folder, and tables that no later step reads are deleted.

Defined cases: a null or blank text has an empty set, size 0, and is its own component; a text of fewer than n words has
its whole sequence as the one element; repeated rows are copies; an empty table gives an empty result; extra columns do no
harm. A null id is kept, with a null component if it is in no component with an id.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left
from dataclasses import dataclass
from heapq import heapify, heapreplace, heappop

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.llm import batches, features, graph
from tessel.session import checkpoint, release
from tessel.sources.tables import table

BLOCK_DOCS = 4000
BLOCK_SHINGLES = 2_000_000
#: Parts beyond those that differences can touch; a set with more empty parts than this signs those too.
SPARE = 6
#: Prefixes are longer by size / EXTRA than a link needs, and so many of them must be found elsewhere.
EXTRA = 10
#: Rounds of dropping sets that share too few signatures; any number is exact, later rounds find little.
PEEL_ROUNDS = 3
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingles of ``words`` words; two sets link when den * |intersection| >= num * |union|."""

    words: int = 3
    num: int = 90
    den: int = 100

    def linked(self, both: int, a: int, b: int) -> bool:
        return self.den * both >= self.num * (a + b - both)

    def classes(self, size: int) -> list[tuple[int, int]]:
        """(size class, parts) of a set: its own class and the next, where a larger partner signs."""
        start, number = 1, 0
        while (stop := start * self.den // self.num + 1) <= size:
            start, number = stop, number + 1
        after = stop * self.den // self.num + 1
        out = []
        for c, end in ((number, stop), (number + 1, after)):
            if differ := 2 * (end - 1) * (self.den - self.num) // (self.den + self.num):
                out.append((c, differ + 1 + SPARE))
        return out

    def prefix(self, size: int) -> int:
        """How many of a set's least hashes make its prefix: more than a partner may lack, by a share of the size."""
        return min(size, size - -(-self.num * size // self.den) + max(1, size // EXTRA))

    def least_shared(self, size: Column) -> Column:
        """How many of the prefix a linked partner's prefix has at least.

        The partners have c common elements, c no less than num / den of either size. Of the first k of them in the order
        of hashes, a set has at most size - c others before the last, so for k up to size / EXTRA they lie in its prefix;
        and the smaller set is no smaller than num / den of this one.
        """
        return F.greatest(F.lit(1), F.floor(F.ceil(size * self.num / self.den) / EXTRA)).cast("bigint")


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    raw, offsets = batches.flat(texts)
    raw = _LOWER[raw]
    starts, ends, doc = batches.words(raw, offsets)
    _, h = features.word_hashes(raw, starts, ends)
    edge = np.searchsorted(doc, np.arange(len(offsets)))
    grams = np.zeros(0, np.uint64)
    if (size := len(h) - words + 1) > 0:
        grams = h[:size].copy()
        for k in range(1, words):
            grams = features.mix(grams * _P + h[k : size + k])
    out = []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(grams[a : b - words + 1]))
        elif b > a:
            one = np.uint64(b - a)
            for x in h[a:b]:
                one = features.mix(np.array([one]) * _P + x)[0]
            out.append(np.array([one]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits of a set."""
    a, b = features.mix(own), features.mix(own ^ _P)
    return np.array([np.add.reduce(a), np.add.reduce(b)], np.uint64).tobytes()


def signatures(own: np.ndarray, rule: Rule) -> list[tuple[int, int, np.ndarray]]:
    """(size class, need, hashes of parts) for each of a set's size classes; equal parts of one class have equal hashes.

    A linked set has at least ``need`` of the hashes in that class as well: of SPARE + 1 equal parts, some may be empty
    in both sets, and empty parts are signed only where there are more than SPARE of them.
    """
    found = []
    with np.errstate(over="ignore"):
        place, value = features.mix(own ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32), features.mix(own + _P)
        for number, parts in rule.classes(len(own)):
            part = (place * np.uint64(parts)) >> np.uint64(32)
            order = np.argsort(part, kind="stable")
            held, begin = np.unique(part[order], return_index=True)
            sums = np.add.reduceat(value[order], begin)
            need = SPARE + 1 - (parts - len(held))
            if need < 1:
                rest = np.setdiff1d(np.arange(parts, dtype=np.uint64), held)
                held, sums, need = np.concatenate([held, rest]), np.concatenate([sums, np.zeros(len(rest), np.uint64)]), 1
            found.append((number, need, features.mix(sums + features.mix(held * _P + np.uint64(number + 1)))))
    return found


def profile(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text", mark: str | None = None) -> DataFrame:
    """(id, mark, own, n, print, node) of every row; mark is a column of ``docs`` that is passed on, own a hash of the text,
    node the fingerprint's first 64 bits."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                sets = shingle_sets(part.column("text"), rule.words)
                prints = [fingerprint(s) if len(s) else None for s in sets]
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array([p and _node(p) for p in prints], pa.int64())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "mark", "own")), *columns], names=["id", "mark", "own", "n", "print", "node"])

    carried = (F.col(mark) if mark else F.lit(None)).cast("bigint").alias("mark")
    chosen = docs.select(F.col(key).cast("bigint").alias("id"), carried, F.xxhash64(text).alias("own"), F.col(text).alias("text"))
    return chosen.transform(batches.bounded).mapInArrow(run, "id bigint, mark bigint, own bigint, n bigint, print binary, node bigint")


def _node(mark: bytes) -> int:
    return int.from_bytes(mark[:8], "little", signed=True)


def prefix_rows(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(node, token) rows of a slice's sets: what :func:`shared_prefixes` counts.

    Of sets that have one token in common, two give a row each and the others only add to their own counts: they are
    known to share it. So a token that is everywhere makes two rows a slice. A set's count is a row with the topmost bit
    set, the count below it, and half the node to tell rows apart.
    """
    own = {fingerprint(s): s for s in sets if len(s)}
    heads = [s[: rule.prefix(len(s))] for s in own.values()]
    owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
    tokens = np.concatenate([np.zeros(0, np.uint64), *heads])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    third = np.zeros(len(tokens), bool)
    third[2:] = tokens[2:] == tokens[:-2]
    nodes = np.array([_node(p) for p in own], np.int64)
    counts = np.bincount(owner[third], minlength=len(heads)).astype(np.uint64)
    counted = np.uint64(1 << 63) | (counts << np.uint64(32)) | (nodes.view(np.uint64) & np.uint64(0xFFFFFFFF))
    return np.concatenate([nodes[owner[~third]], nodes]), np.concatenate([features.mix(tokens[~third]) >> np.uint64(1), counted]).view(np.int64)


def shared_prefixes(docs: DataFrame, rule: Rule, text: str = "text") -> DataFrame:
    """(node, hits, slices) of every distinct set: of its least hashes (:meth:`Rule.prefix`) hits / slices occur in the
    prefixes of other sets; a set that is in several slices of rows is counted in each of them."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in prefix_rows(shingle_sets(part.column("text"), rule.words), rule)], names=["node", "token"])

    same = Window.partitionBy("token")
    rows = docs.select(F.col(text).alias("text")).transform(batches.bounded).mapInArrow(run, "node bigint, token bigint")
    met = rows.withColumns({"least": F.min("node").over(same), "most": F.max("node").over(same)})
    hits = F.when(F.col("token") < 0, F.shiftright("token", 32).bitwiseAND(0x7FFFFFFF)).otherwise((F.col("least") != F.col("most")).cast("bigint"))
    return met.groupBy("node").agg(F.sum(hits).alias("hits"), F.sum((F.col("token") < 0).cast("bigint")).alias("slices"))


def survivors(docs: DataFrame, reps: DataFrame, rule: Rule, key: str, text: str) -> DataFrame:
    """(id, n, print, text) of the sets that may link: one row for each node, which is its id here.

    Two linked sets have as many of their least hashes in common as :meth:`Rule.least_shared` says, so a set whose prefix
    shares fewer with all others together has no link. That leaves copies, near copies and little else.
    """
    counts = shared_prefixes(docs, rule, text).select(F.col("node").alias("c_node"), "hits", "slices")
    # What writes ``may`` reads the counts, so its tasks follow the rows of all prefixes, not its own few.
    read = int(reps.agg(F.sum(F.col("n") * (rule.den - rule.num) / rule.den + F.col("n") / EXTRA + 2)).first()[0] or 0)
    may = reps.join(counts, F.col("node") == F.col("c_node")).filter(F.col("hits") >= rule.least_shared(F.col("n")) * F.col("slices"))
    may = checkpoint(may.select(F.col("rep.id").alias("r_id"), F.col("rep.own").alias("r_own"), "node", "n", "print"), read)
    # The only shuffle of texts: ids of the few that survive meet them, and one of repeated rows stays.
    texts = docs.select(F.col(key).cast("bigint").alias("t_id"), F.xxhash64(text).alias("t_own"), F.col(text).alias("text"))
    met = texts.join(may, (F.col("t_id") == F.col("r_id")) & (F.col("t_own") == F.col("r_own")))
    first = F.row_number().over(Window.partitionBy("t_id", "t_own").orderBy("node"))
    kept = checkpoint(met.withColumn("first", first).filter("first = 1").select(F.col("node").alias("id"), "n", "print", "text"))
    release(may)
    return kept


def signed(kept: DataFrame, rule: Rule) -> DataFrame:
    """(node, class, need, sign) of every signature of the sets of rows (id, text)."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                rows = [(node, *sign) for node, s in zip(part.column("id").to_pylist(), shingle_sets(part.column("text"), rule.words), strict=True) for sign in signatures(s, rule)]
                lengths = [len(r[3]) for r in rows]
                numbers = [pa.array(np.repeat(np.array([r[k] for r in rows], kind), lengths)) for k, kind in ((0, np.int64), (1, np.int32), (2, np.int32))]
                signs = np.concatenate([np.zeros(0, np.uint64), *(r[3] for r in rows)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*numbers, pa.array(signs)], names=["node", "class", "need", "sign"])

    return kept.select("id", "text").transform(batches.bounded).mapInArrow(run, "node bigint, class int, need int, sign bigint")


def shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows of (node, key, ...) whose key another node has as well, with ``least``, the least node of the key.

    Least and most are combined before they are shuffled, and adaptive execution can split the rows of a common key in
    the join, so none has to fit a task.
    """
    ends = rows.groupBy(F.col(key).alias("s_key")).agg(F.min("node").alias("least"), F.max("node").alias("most"))
    return rows.join(ends.filter("least != most").drop("most"), F.col(key) == F.col("s_key")).drop("s_key")


def groups_of(rows: DataFrame) -> DataFrame:
    """(id, component) of the nodes of ``shared`` rows, over chains of shared keys."""
    edges = rows.filter("node != least").select(F.col("node").alias("u"), F.col("least").alias("v")).distinct()
    return graph.components(edges, rows.count())


def _peeled(rows: DataFrame, by: list[str], rounds: int = PEEL_ROUNDS) -> DataFrame:
    """Shared rows (node, need, sign, ...) of those groups ``by`` that have ``need`` shared rows or more. Dropping some may
    leave others short, so it is repeated. ``rows`` is a written table, which this deletes."""
    first = checkpoint(shared(rows, "sign"), rows.count())
    release(rows)
    rows = first
    for _ in range(rounds):
        most = rows.count()
        counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max("need").alias("need")).filter("n >= need").select(*by)
        left = checkpoint(rows.drop("least").join(counts, by, "left_semi"), most)
        after = checkpoint(shared(left, "sign"), most)
        release(rows, left)
        rows = after
    return rows


def candidate_signs(kept: DataFrame, rule: Rule) -> DataFrame:
    """Shared signatures (node, class, need, sign, least). A set that shares fewer signatures of a class with all others
    than a linked one would with a single partner drops that class."""
    return _peeled(checkpoint(signed(kept, rule)), ["node", "class"])


def element_survivors(rows: DataFrame, kept: DataFrame, rule: Rule) -> DataFrame:
    """(node) of rows (id) that share enough elements with other rows for a link.

    A link needs num / den of a set's elements in common with one partner, so at least as many must occur in any other
    set. Sets that only have passages in common fail this, however many there are.
    """

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                sets = shingle_sets(part.column("text"), rule.words)
                lengths = [len(s) for s in sets]
                need = np.array([-(-rule.num * n // rule.den) for n in lengths], np.int32)
                flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("id").to_numpy(zero_copy_only=False), lengths)), pa.array(np.repeat(need, lengths)), pa.array(flat)], names=["node", "need", "sign"])

    elements = kept.join(rows.select("id"), "id", "left_semi").select("id", "text").transform(batches.bounded).mapInArrow(run, "node bigint, need int, sign bigint")
    return _peeled(checkpoint(elements), ["node"], 2).select("node").distinct()


# Search


#: From so many entries of short lists on, they are merged as sorted runs of one array instead of by a heap: the same merge, many entries at a time.
HEAP_ENTRIES = 400


def t_occurrence(lists: list[array], least: int) -> dict[int, int]:
    """Documents that occur in at least ``least`` of the ascending lists, with their number of occurrences.

    DivideSkip: the L longest lists are set aside, the others are merged, and what occurs at least ``least`` - L times
    there is looked up in the long lists by binary search until it can't reach ``least`` any more.
    """
    if least < 1 or len(lists) < least:
        return {}
    lists = sorted(lists, key=len)
    # The published choice of L, with its constant 0.0085.
    n_long = min(least - 1, int(least / (0.0085 * math.log2(len(lists[-1]) + 1) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    if sum(map(len, short)) > HEAP_ENTRIES:
        return _by_runs(short, long, least)
    heap = [(own[0], i, 0) for i, own in enumerate(short)]
    heapify(heap)
    need, found = least - n_long, {}
    while heap:
        document, count = heap[0][0], 0
        while heap and heap[0][0] == document:
            _, i, at = heap[0]
            count += 1
            if at + 1 < len(short[i]):
                heapreplace(heap, (short[i][at + 1], i, at + 1))
            else:
                heappop(heap)
        if count < need:
            continue
        for left, own in zip(range(n_long, 0, -1), long, strict=True):
            if count + left < least:
                break
            at = bisect_left(own, document)
            count += at < len(own) and own[at] == document
        if count >= least:
            found[document] = count
    return found


def _by_runs(short: list[array], long: list[array], least: int) -> dict[int, int]:
    """The same on whole arrays: a stable sort takes each ascending list as one run and merges runs."""
    entries = np.sort(np.concatenate([np.frombuffer(own, np.int32) for own in short]), kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], entries[1:] != entries[:-1]]))
    merged, count = entries[begin], np.diff(np.concatenate([begin, [len(entries)]]))
    keep = count >= least - len(long)
    merged, count = merged[keep], count[keep]
    for left, own in zip(range(len(long), 0, -1), long, strict=True):
        if left % 8 == 0:
            keep = count + left >= least
            merged, count = merged[keep], count[keep]
        if not len(merged):
            return {}
        view = np.frombuffer(own, np.int32)
        count += view[np.minimum(np.searchsorted(view, merged), len(view) - 1)] == merged
    keep = count >= least
    return dict(zip(merged[keep].tolist(), count[keep].tolist(), strict=True))


def dense_tokens(sets: list[np.ndarray]) -> tuple[list[np.ndarray], int]:
    """Each set's elements that another set has as well, numbered from 0 on, and how many numbers there are. An element
    that only one set has is in no intersection, so it needs no list."""
    own = np.concatenate([np.zeros(0, np.uint64), *sets])
    _, number, count = np.unique(own, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    keep, edge = count[number] > 1, np.cumsum([0, *map(len, sets)])
    kept = place[number[keep]].astype(np.int32)
    edge = np.concatenate([[0], np.cumsum(keep)])[edge]
    return [kept[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)], int((count > 1).sum())


class Index:
    """Inverted lists of elements over the documents put in, in ascending order."""

    def __init__(self, elements: int) -> None:
        self.lists: list = [None] * elements

    @classmethod
    def over(cls, tokens: list[np.ndarray], elements: int) -> Index:
        """The index of all documents at once: its lists are slices of one array."""
        made, flat = cls(elements), np.concatenate([np.zeros(0, np.int32), *tokens])
        owner = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(t) for t in tokens])[np.argsort(flat, kind="stable")]
        edge, view = np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=elements))]).tolist(), memoryview(owner)
        made.lists = [view[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return made

    def add(self, document: int, tokens: np.ndarray) -> None:
        for token in tokens.tolist():
            if (own := self.lists[token]) is None:
                self.lists[token] = array("i", (document,))
            else:
                own.append(document)

    def search(self, tokens: np.ndarray, size: int, num: int, den: int) -> dict[int, int]:
        """Documents that may reach similarity num / den with a set of ``size`` elements, with the size of the
        intersection."""
        least = max(1, -(-num * size // den))
        if len(tokens) < least:
            return {}
        return t_occurrence([own for t in tokens.tolist() if (own := self.lists[t]) is not None], least)


def solve(sets: list[np.ndarray], rule: Rule, seeds: list | None = None) -> tuple[list[int], list[bool]]:
    """(root, whether it is a leader) of each set of a group: sets have one root exactly when links or seeds join them."""
    n = len(sets)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def union(x: int, y: int) -> None:
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)

    if seeds is not None:
        first: dict = {}
        for i, s in enumerate(seeds):
            union(i, first.setdefault(s, i))
    (tokens, elements), size = dense_tokens(sets), [len(s) for s in sets]
    lead, leaders, index = list(range(n)), [], Index(elements)
    followed = set()
    for x in range(n):
        hits = [y for y, both in index.search(tokens[x], size[x], rule.num, rule.den).items() if rule.linked(both, size[x], size[y])]
        if hits:
            lead[x] = hits[0]
            followed.add(hits[0])
            for y in hits:
                union(x, y)
        else:
            leaders.append(x)
            index.add(x, tokens[x])
    is_leader = [lead[x] == x for x in range(n)]
    if not followed or len({find(y) for y in leaders}) == 1:
        return [find(x) for x in range(n)], is_leader
    # A follower lies within one gap of its leader. So where a follower links into another component, the two leaders
    # lie within two gaps if one of them has no followers, and within three otherwise.
    gap, near = rule.den - rule.num, {x: [] for x in leaders}
    for x in leaders:
        for y, both in index.search(tokens[x], size[x], max(1, rule.den - 3 * gap), rule.den).items():
            gaps = (x in followed) + (y in followed) + 1
            either = size[x] + size[y] - both
            if y < x and gaps > 1 and find(x) != find(y) and rule.den * both >= (rule.den - gaps * gap) * either:
                near[x].append(y)
                near[y].append(x)
    whole = None
    for x in range(n):
        if is_leader[x] or all(find(y) == find(x) for y in near[lead[x]]):
            continue
        whole = whole or Index.over(tokens, elements)
        for y, both in whole.search(tokens[x], size[x], rule.num, rule.den).items():
            if rule.linked(both, size[x], size[y]):
                union(x, y)
    return [find(x) for x in range(n)], is_leader


def _solve_blocks(rows: DataFrame, texts: DataFrame, rule: Rule, seeded: bool = False) -> DataFrame:
    """(id, comp, label, leader) from rows (id, comp, block[, seed]); a group is one (comp, block)."""

    def groups(found):
        """((comp, block), [(id, seed, set)]) from the sorted rows."""
        name, held = None, []
        for batch in found:
            for part in batches.slices(batch, "text"):
                sets = shingle_sets(part.column("text"), rule.words)
                for comp, block, i, seed, own in zip(*[part.column(c).to_pylist() for c in ("comp", "block", "id", "seed")], sets, strict=True):
                    if (comp, block) != name:
                        if held:
                            yield name, held
                        name, held = (comp, block), []
                    held.append((i, seed, own))
        if held:
            yield name, held

    def run(found):
        out: list[tuple] = []
        for (comp, _), held in groups(found):
            roots, lead = solve([h[2] for h in held], rule, [h[1] for h in held] if seeded else None)
            out += [(h[0], comp, held[r][0], leader) for h, r, leader in zip(held, roots, lead, strict=True)]
            if len(out) > 20_000:
                yield _labels(out)
                out = []
        if out:
            yield _labels(out)

    seed = F.col("seed") if seeded else F.lit(None).cast("bigint")
    named = texts.select(F.col("id").alias("t_id"), "text")
    joined = rows.withColumn("seed", seed).join(named, F.col("id") == F.col("t_id")).select("comp", "block", "id", "seed", "text")
    # A fixed number of partitions: by their bytes alone, adaptive execution would put this work into very few tasks.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return joined.repartition(tasks, "comp", "block").sortWithinPartitions("comp", "block", "id").transform(batches.bounded).mapInArrow(run, "id bigint, comp bigint, label bigint, leader boolean")


def _labels(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "comp", "label", "leader"])


def _blocked(rows: DataFrame, block_docs: int, block_shingles: int, salt: int, by: tuple[str, ...] = ("comp",)) -> DataFrame:
    """rows (id, n, *by) with their group's number of blocks and each row's block."""
    blocks = F.greatest(F.ceil(F.count("*") / block_docs), F.ceil(F.sum("n") / block_shingles)).cast("bigint")
    sizes = rows.groupBy(*[F.col(c).alias(f"s_{c}") for c in by]).agg(blocks.alias("blocks"))
    joined = rows
    for k, c in enumerate(by):
        same = (F.col(c) == F.col(f"s_{c}")) if not k else same & (F.col(c) == F.col(f"s_{c}"))
    joined = joined.join(sizes, same).drop(*[f"s_{c}" for c in by])
    return joined.withColumn("block", F.pmod(F.xxhash64("id", F.lit(salt)), F.col("blocks")))


def _visits(others: DataFrame, marked: DataFrame, signs: DataFrame) -> DataFrame:
    """(id, home) of those blocks home of its group that may hold a partner of a row of ``others``: blocks in which ``need``
    of its signatures of a class occur. ``signs`` has (node, class, need, sign)."""
    where = signs.join(marked.select("id", F.col("block").alias("home")), F.col("node") == F.col("id")).select(F.col("sign").alias("w_sign"), "home").distinct()
    asked = signs.select("node", "class", "need", "sign").join(others.select("id"), F.col("node") == F.col("id"))
    met = asked.join(where, F.col("sign") == F.col("w_sign")).groupBy("id", "class", "home").agg(F.count("*").alias("met"), F.max("need").alias("need"))
    return met.filter("met >= need").select("id", "home").distinct()


def links(candidates: DataFrame, texts: DataFrame, signs: DataFrame, rule: Rule, block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(id, label) of candidates (id, n, comp): ids with one label are joined by links, and only those.

    ``texts`` has (id, text), ``signs`` the shared signatures (node, class, need, sign) of the candidates: linked ones
    share ``need`` of a class.
    """
    most = candidates.count()
    placed = checkpoint(_blocked(candidates, block_docs, block_shingles, 0), most)
    solved = checkpoint(_solve_blocks(placed, texts, rule))
    large = placed.filter("blocks > 1")
    if large.isEmpty():
        return solved.select("id", "label")
    pair = lambda rows: rows.select(F.col("id").alias("u"), F.col("label").alias("v"))
    edges, lead, before, salt = pair(solved), large.select("id", "n", "comp"), None, 0
    while True:  # leaders of all blocks of a group, level by level
        lead = checkpoint(lead.join(solved.filter("leader").select("id"), "id", "left_semi"), most)
        now, salt = lead.count(), salt + 1
        if before is not None and now > 0.9 * before:
            break
        before = now
        again = checkpoint(_blocked(lead, block_docs, block_shingles, salt), now)
        solved = checkpoint(_solve_blocks(again, texts, rule))
        edges = edges.union(pair(solved))
        if again.filter("blocks > 1").isEmpty():
            break
    marked = checkpoint(large.join(graph.components(edges), "id", "left").select("id", "n", "comp", "block", F.coalesce("component", "id").alias("seed")), most)
    counts = marked.groupBy("comp", "seed").agg(F.count("*").alias("rows"))
    main = counts.groupBy("comp").agg(F.max(F.struct("rows", "seed")).alias("top")).select(F.col("comp").alias("m_comp"), F.col("top.seed").alias("main"))
    others = checkpoint(marked.join(main, F.col("comp") == F.col("m_comp")).filter("seed != main").select("id", "n", "comp", "seed"), most)
    if others.isEmpty():
        return graph.components(edges).select("id", F.col("component").alias("label"))
    # What is outside a group's main component meets the blocks that may hold a partner, in chunks of a block's size.
    visits = _visits(others, marked, signs).withColumnRenamed("id", "v_id")
    asked = checkpoint(_blocked(others.join(visits, F.col("id") == F.col("v_id")).drop("v_id"), block_docs, block_shingles, -1, ("comp", "home")))
    chunks = asked.select(F.col("comp").alias("c_comp"), F.col("home").alias("c_home"), "blocks").distinct()
    stored = marked.join(chunks, (F.col("comp") == F.col("c_comp")) & (F.col("block") == F.col("c_home"))).drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.concat_ws(":", "home", "block").alias("block")
    every = asked.select("id", "comp", "seed", name).union(stored.select("id", "comp", "seed", F.concat_ws(":", "c_home", "block").alias("block"))).distinct()
    crossed = checkpoint(_solve_blocks(every, texts, rule, seeded=True))
    seeds = marked.select(F.col("id").alias("u"), F.col("seed").alias("v"))
    return graph.components(edges.union(seeds).union(pair(crossed))).select("id", F.col("component").alias("label"))


def join(docs: DataFrame, rule: Rule | None = None, key: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_shingles: int = BLOCK_SHINGLES, mark: str | None = None) -> DataFrame:
    """(id, mark, n, print, representative, component) of every row; print is null for an empty set."""
    rule = rule or Rule()
    profiled = checkpoint(profile(docs, rule, key, text, mark))
    least = F.min(F.struct("id", "own")).alias("rep")
    reps = checkpoint(profiled.filter("n > 0 AND id IS NOT NULL").groupBy("print").agg(least, F.max("n").alias("n"), F.max("node").alias("node")), profiled.count())
    kept = survivors(docs, reps, rule, key, text)
    n_kept = kept.count()
    signs = candidate_signs(kept, rule)

    def candidates_of(signs: DataFrame) -> DataFrame:
        groups = groups_of(signs).select(F.col("id").alias("g_id"), F.col("component").alias("comp"))
        return checkpoint(kept.select("id", "n").join(groups, F.col("id") == F.col("g_id")).drop("g_id"), n_kept)

    candidates = candidates_of(signs)
    large = _blocked(candidates, block_docs, block_shingles, 0).filter("blocks > 1").select("id")
    if not large.isEmpty():  # what chains them may be passages only
        gone = large.join(element_survivors(large, kept, rule).select(F.col("node").alias("id")), "id", "left_anti")
        most = signs.count()
        left = checkpoint(signs.drop("least").join(gone, F.col("node") == F.col("id"), "left_anti"), most)
        signs = checkpoint(shared(left, "sign"), most)
        candidates = candidates_of(signs)
    labelled = checkpoint(links(candidates, kept, signs, rule, block_docs, block_shingles).withColumnRenamed("id", "l_id"), n_kept)
    release(kept, signs)
    classes = reps.select("print", F.col("rep.id").alias("rep"), "node").join(labelled, F.col("node") == F.col("l_id"), "left").withColumn("label", F.coalesce("label", "node"))
    least = classes.groupBy(F.col("label").alias("c_label")).agg(F.min("rep").alias("component"))
    named = classes.join(least, F.col("label") == F.col("c_label")).select(F.col("print").alias("c_print"), "rep", "component")
    joined = profiled.join(named, F.col("print") == F.col("c_print"), "left")
    return joined.select("id", "mark", "n", "print", F.coalesce("rep", "id").alias("representative"), F.coalesce("component", "id").alias("component"))


def keep_one(docs: DataFrame, rule: Rule, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each component the row of least id (of repeated rows one), and every row with
    an empty set. Rows are told apart by a 64-bit hash of id and text, so an id may come with several texts, or be null."""
    own = F.xxhash64(F.col(key).cast("bigint"), F.col(text))
    work = docs.select(own.alias("id"), F.col(key).cast("bigint").alias("mark"), F.col(text).alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = join(work, rule, "id", "text", mark="mark")
    stay = joined.filter("n > 0").groupBy("component").agg(F.min(F.struct("mark", "id")).alias("one")).select(F.col("one.id").alias("s_id"))
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # The window takes rows as the join has dealt and sorted them.
    first = F.row_number().over(Window.partitionBy("id").orderBy("id"))
    one = work.filter(~blank).select("id", "row").join(stay, F.col("id") == F.col("s_id"), "left_semi").withColumn("first", first).filter("first = 1")
    return one.select("row").union(work.filter(blank).select("row")).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = join(table(spark, sf_dir, "documents"))
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d
), t AS (
  SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s
), p AS (
  SELECT a.doc_id AS u, b.doc_id AS v, a.n AS na, b.n AS nb, count(*) AS shared FROM t a JOIN t b ON a.x = b.x AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY ALL
), e AS (
  SELECT u, v FROM p WHERE 100 * shared >= 90 * (na + nb - shared)
), r AS (
  SELECT doc_id AS id, doc_id AS reached FROM s UNION SELECT r.id, e.v FROM r JOIN e ON r.reached = e.u
)
SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.reached) AS component_id FROM s JOIN r ON r.id = s.doc_id GROUP BY ALL
"""
