"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Encoding follows a byte-level BPE tokenizer file: a text is cut at the file's special tokens, then into pre-tokens, and
in each pre-token adjacent pairs are merged in the order of their rank, leftmost first. A segment tree has a leaf for
each position, holding (rank of the pair that starts there, position); its root is therefore the leftmost pair of lowest
rank. A merge changes three leaves and their paths to the root, so a pre-token of n bytes takes O(n log n), whatever its
length. Short pre-tokens of a slice are merged together, all trees of one size side by side in an array; long ones take
a tree of their own.

Pre-tokens recur, so each slice of up to a few MB merges its distinct ones only, and a worker keeps a bounded pool of
those it has met. Texts are cut at ASCII white space first, which a pre-token never spans except for one leading space;
texts with other white space or special tokens are cut whole by the pattern.

Defined cases: null encodes as an empty text, which has no ids and decodes to an empty text; texts of any length are
encoded whole; the order of the rows, repeated rows, empty tables and extra columns do not matter. Ids are packed as
little-endian unsigned 32-bit integers. Bytes that are not UTF-8 after decoding become U+FFFD, as in the library.

The tokenizer file is read on the driver and broadcast, at most ``MAX_FILE_BYTES``.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import batches
from tessel.sources.tables import table

# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MAX_FILE_BYTES = 64 << 20
#: Pieces that a worker remembers; beyond that it starts anew.
POOL_PIECES = 500_000
#: Bytes of text or ids that are coded at once; the work needs some hundred times as much.
CODE_BYTES = 1 << 20
#: Pre-tokens up to this many bytes are merged side by side.
SHORT = 64
NEVER = np.int32(2**31 - 1)


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: printable Latin-1 is itself, the others follow from code point 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairTable:
    """(left id, right id) -> (rank, merged id), as an open-addressing table that looks up whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray, width: int) -> None:
        self.width = width
        keys = left.astype(np.int64) * width + right
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NEVER, np.int32)
        self.merged = np.zeros(1 << self.bits, np.int32)
        self.one = {}
        for rank, (key, new) in enumerate(zip(keys.tolist(), merged.tolist(), strict=True)):
            if key in self.one:
                continue
            self.one[key] = rank, new
            slot = int(self._slot(np.array([key]))[0])
            while self.keys[slot] != -1:
                slot = (slot + 1) & ((1 << self.bits) - 1)
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, new

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def slots(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; an empty slot where there is no such pair. Its rank there is NEVER."""
        keys = left.astype(np.int64) * self.width + right
        slot = self._slot(keys)
        found = self.keys[slot]
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return slot


class Tokenizer:
    """A byte-level BPE tokenizer from the JSON text of its file."""

    def __init__(self, document: bytes) -> None:
        data = json.loads(document)
        model, alphabet = data["model"], byte_alphabet()
        vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        width = max([*vocab.values(), *(t["id"] for t in data.get("added_tokens", []))]) + 1
        left, right, merged = (np.array(x, np.int64) for x in zip(*[(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], strict=True))
        self.pairs = PairTable(left, right, merged, width)
        self.byte_id = np.zeros(256, np.int32)
        spelled = {i: bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode() for t, i in vocab.items()}
        for char, byte in alphabet.items():
            self.byte_id[byte] = vocab[char]
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        spelled |= {i: t.encode() for t, i in self.special.items()}
        table = [spelled.get(i, b"") for i in range(width)]
        self.token_length = np.array([len(t) for t in table], np.int64)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(table), np.uint8)
        self.pattern = regex.compile(PATTERN)
        ordered = sorted(self.special, key=len, reverse=True)
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, ordered)) + ")") if ordered else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.chunks: list[np.ndarray] = []
        self.counts: list[int] = []

    # Merging

    def merge_long(self, token: bytes) -> list[int]:
        """Ids of one pre-token, with a segment tree of its own."""
        n = len(token)
        ids = self.byte_id[np.frombuffer(token, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find, width, size = self.pairs.one, self.pairs.width, 1
        while size < n:
            size *= 2
        none = (1 << 62, -1)
        tree = [none] * (2 * size)
        for i in range(n - 1):
            if (hit := find.get(ids[i] * width + ids[i + 1])) is not None:
                tree[size + i] = (hit[0], i)
        for node in range(size - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(i: int, value: tuple[int, int]) -> None:
            node = size + i
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        def rank(i: int) -> tuple[int, int]:
            if i < 0 or after[i] >= n:
                return none
            hit = find.get(ids[i] * width + ids[after[i]])
            return none if hit is None else (hit[0], i)

        while tree[1] != none:
            i = tree[1][1]
            gone = after[i]
            ids[i] = find[ids[i] * width + ids[gone]][1]
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none)
            put(i, rank(i))
            if before[i] >= 0:
                put(before[i], rank(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def merge_short(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids) of many pre-tokens of up to SHORT bytes, given as spans of ``raw``."""
        counts = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (1, 2, 4, 8, 16, 32, 64):
            own = np.flatnonzero((lengths > low) & (lengths <= high))
            low = high
            for at in range(0, len(own), 1 << 17):
                part = own[at : at + (1 << 17)]
                ids, live = self._merge_class(raw, starts[part], lengths[part], high)
                counts[part] = live.sum(1)
                found.append((part, ids[live]))
        total = np.zeros(int(counts.sum()), np.int32)
        begin = np.cumsum(counts) - counts
        for part, ids in found:
            total[batches.ragged(begin[part], counts[part])] = ids
        return total, counts

    def _merge_class(self, raw, starts, lengths, size):
        """Ids and live positions, as arrays [word, size], of words of up to ``size`` bytes: one tree a word."""
        n, place = len(starts), np.arange(size)
        live = place[None, :] < lengths[:, None]
        ids = np.zeros((n, size), np.int32)
        ids[live] = self.byte_id[raw[batches.ragged(starts, lengths)]]
        if size == 1:
            return ids, live
        pairs, shift = self.pairs, size.bit_length() - 1
        tree = np.full((n, 2 * size), NEVER, np.int64)
        both = live[:, :-1] & live[:, 1:]
        ranks = pairs.ranks[pairs.slots(ids[:, :-1][both], ids[:, 1:][both])].astype(np.int64)
        where = np.nonzero(both)
        tree[where[0], size + where[1]] = np.where(ranks == NEVER, NEVER, (ranks << shift) | where[1])
        for level in range(shift - 1, -1, -1):
            k = 1 << level
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        after = np.minimum(place[None, :] + 1, lengths[:, None]).astype(np.int16)
        before = np.broadcast_to(place - 1, (n, size)).astype(np.int16)
        rows = np.flatnonzero(tree[:, 1] != NEVER)

        def rank(row, at):
            """The leaf of each position: its pair's rank and the position itself."""
            value = np.full(len(row), NEVER, np.int64)
            right = after[row, np.maximum(at, 0)]
            ok = np.flatnonzero((at >= 0) & (right < lengths[row]))
            r, a = row[ok], at[ok]
            got = pairs.ranks[pairs.slots(ids[r, a], ids[r, right[ok]])].astype(np.int64)
            value[ok] = np.where(got == NEVER, NEVER, (got << shift) | a)
            return value

        while len(rows):
            at = tree[rows, 1] & (size - 1)
            gone = after[rows, at].astype(np.int64)
            ids[rows, at] = pairs.merged[pairs.slots(ids[rows, at], ids[rows, gone])]
            behind = after[rows, gone]
            after[rows, at] = behind
            inside = np.flatnonzero(behind < lengths[rows])
            before[rows[inside], behind[inside]] = at[inside]
            live[rows, gone] = False
            prior = before[rows, at].astype(np.int64)
            tree[rows, size + gone] = NEVER
            tree[rows, size + at] = rank(rows, at)
            has = np.flatnonzero(prior >= 0)
            tree[rows[has], size + prior[has]] = rank(rows[has], prior[has])
            for node in (size + gone, size + at, size + np.where(prior >= 0, prior, at)):
                for _ in range(shift):
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            rows = rows[tree[rows, 1] != NEVER]
        return ids, live

    # Cutting

    def _learn(self, new: list[bytes], cut: list[bool]) -> None:
        """Put the ids of new pieces into the pool. cut: whether a piece may hold several pre-tokens."""
        parts: list[bytes] = []
        counts: list[int] = []
        findall = self.pattern.findall
        for piece, several in zip(new, cut, strict=True):
            if several:
                found = [t.encode() for t in findall(piece.decode("utf-8", "surrogatepass"))]
                parts += found
                counts.append(len(found))
            else:
                parts.append(piece)
                counts.append(1)
        lengths = np.array([len(p) for p in parts], np.int64)
        raw, starts = np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths
        short = np.flatnonzero(lengths <= SHORT)
        ids_short, n_short = self.merge_short(raw, starts[short], lengths[short])
        n = np.zeros(len(parts), np.int64)
        n[short] = n_short
        longer = [(i, np.array(self.merge_long(parts[i]), np.int32)) for i in np.flatnonzero(lengths > SHORT)]
        for i, ids in longer:
            n[i] = len(ids)
        begin = np.cumsum(n) - n
        out = np.zeros(int(n.sum()), np.int32)
        out[batches.ragged(begin[short], n_short)] = ids_short
        for i, ids in longer:
            out[begin[i] : begin[i] + len(ids)] = ids
        edges = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(n)])
        base = len(self.counts)
        for k, piece in enumerate(new):
            self.known[piece] = base + k
        self.counts += (ends[edges[1:]] - ends[edges[:-1]]).tolist()
        self.chunks.append(out)

    def _pool(self, distinct: list[bytes], cut: np.ndarray) -> np.ndarray:
        """Pool positions of distinct pieces, after adding those that are new."""
        at = list(map(self.known.get, distinct))
        if new := [i for i, p in enumerate(at) if p is None]:
            base = len(self.counts)
            self._learn([distinct[i] for i in new], cut[new].tolist())
            for k, i in enumerate(new):
                at[i] = base + k
        return np.array(at, np.int64)

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of a slice of texts."""
        raw, offsets = batches.flat(texts)
        if len(self.known) > POOL_PIECES:
            self._forget()
        n = len(offsets) - 1
        odd = _odd_documents(raw, offsets, self.special)
        cuts, owner, single = _cuts(raw, offsets)
        use, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(cuts) > 1:
            coded = batches.pieces(raw, cuts).dictionary_encode()
            index, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
            keep = ~odd[owner]
            index, doc = index[keep], owner[keep]
            plain = np.zeros(len(distinct), bool)
            plain[coded.indices.to_numpy()] = single
            pool = self._pool(distinct.to_pylist(), ~plain)
            use = pool[index]
        strange = np.flatnonzero(odd)
        if len(strange):  # their pieces are put in all at once, each before those of later documents
            parts = [self._encode_odd(raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "surrogatepass")) for d in strange]
            lengths = [len(p) for p in parts]
            at = np.repeat(np.searchsorted(doc, strange), lengths)
            use, doc = np.insert(use, at, np.concatenate(parts)), np.insert(doc, at, np.repeat(strange, lengths))
        counts = np.array(self.counts, np.int64)
        ends = np.cumsum(counts)
        flat_ids = np.concatenate(self.chunks) if self.chunks else np.zeros(0, np.int32)
        self.chunks = [flat_ids]
        sizes = counts[use]
        ids = flat_ids[batches.ragged((ends - counts)[use], sizes)]
        per = np.bincount(doc, weights=sizes, minlength=n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])

    def _encode_odd(self, text: str) -> np.ndarray:
        """Pool positions of a text that has special tokens or white space outside ASCII."""
        out: list[int] = []
        for part in self.special_pattern.split(text) if self.special_pattern else [text]:
            if part in self.special:
                name = b"\xff" + part.encode()  # no text has this byte, so the pool's keys don't clash
                if name not in self.known:
                    self.known[name] = len(self.counts)
                    self.counts.append(1)
                    self.chunks.append(np.array([self.special[part]], np.int32))
                out.append(self.known[name])
            elif part:
                found = [t.encode() for t in self.pattern.findall(part)]
                distinct = list(dict.fromkeys(b"\xfe" + t for t in found))
                new = [t for t in distinct if t not in self.known]
                if new:
                    self._learn([t[1:] for t in new], [False] * len(new))
                    base = len(self.counts) - len(new)
                    for k, t in enumerate(new):
                        self.known[t] = base + k
                out += [self.known[b"\xfe" + t] for t in found]
        return np.array(out, np.int64)

    def decode_slice(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the decoded texts, in valid UTF-8."""
        lengths = self.token_length[ids]
        raw = self.token_bytes[batches.ragged(self.token_start[ids], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        try:
            raw.tobytes().decode()
            if not np.any((raw[ends[1:-1][ends[1:-1] < len(raw)]] & 0xC0) == 0x80):
                return raw, ends
        except UnicodeDecodeError:
            pass
        texts = [raw[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])


def _odd_documents(raw: np.ndarray, offsets: np.ndarray, special: dict[str, int]) -> np.ndarray:
    """Documents with white space outside ASCII, with ASCII separators 28 to 31, or with a special token."""
    hits = [np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))]
    # The UTF-8 forms of the other characters of Unicode's White_Space property.
    for first, rest in ((0xC2, (b"\x85", b"\xa0")), (0xE1, (b"\x9a\x80",)), (0xE2, (b"\x80\x80", b"\x80\x81", b"\x80\x82", b"\x80\x83", b"\x80\x84", b"\x80\x85", b"\x80\x86", b"\x80\x87", b"\x80\x88", b"\x80\x89", b"\x80\x8a", b"\x80\xa8", b"\x80\xa9", b"\x80\xaf", b"\x81\x9f")), (0xE3, (b"\x80\x80",))):
        at = np.flatnonzero(raw == first)
        for tail in rest if len(at) else ():
            ok = at[at + len(tail) < len(raw)]
            for k, byte in enumerate(tail):
                ok = ok[raw[ok + 1 + k] == byte]
            hits.append(ok)
    text = raw.tobytes() if special else b""
    for token in special:
        mark, at = token.encode(), -1
        while (at := text.find(mark, at + 1)) >= 0:
            hits.append(np.array([at]))
    odd = np.zeros(len(offsets) - 1, bool)
    odd[np.searchsorted(offsets, np.concatenate(hits), side="right") - 1] = True
    return odd


# Byte classes of _cuts: blank, letter, digit, apostrophe, other ASCII, and bytes whose class is left to the pattern.
_BLANK, _LETTER, _DIGIT, _QUOTE, _MARK, _OPEN_CLASS = range(6)
_CLASS = np.full(256, _OPEN_CLASS, np.uint8)
_CLASS[:128] = _MARK
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[39] = _QUOTE
#: [class, next class]: a pre-token always ends between them. After an apostrophe a contraction may go on.
_ENDS = np.zeros((6, 6), bool)
_ENDS[_LETTER, [_DIGIT, _QUOTE, _MARK]] = True
_ENDS[_DIGIT, [_LETTER, _QUOTE, _MARK]] = True
_ENDS[_MARK, [_LETTER, _DIGIT]] = True
_ENDS[_QUOTE, _DIGIT] = True


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts between pieces, the document of each piece, and whether it is surely one pre-token.

    A piece is a run of solid bytes with the space just before it, cut further wherever two classes of bytes surely end
    a pre-token; or what is left of a run of white space: before solid bytes, its last character unless that is the
    space, and the ones before.
    """
    if not len(raw):
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    kind = _CLASS[raw]
    # The Latin-1 letters from U+00C0 on: two bytes, the first is C3; the multiplication and division signs aren't letters.
    latin = np.flatnonzero(raw[:-1] == 0xC3)
    latin = latin[(raw[latin + 1] != 0x97) & (raw[latin + 1] != 0xB7)]
    kind[latin] = kind[latin + 1] = _LETTER
    blank = kind == _BLANK
    start = np.zeros(len(raw) + 1, bool)
    start[offsets] = True
    turn = np.flatnonzero(~blank[1:] & blank[:-1] & ~start[1:-1]) + 1  # solid after blank, in one document
    edge = np.zeros(len(raw) + 1, bool)
    edge[turn[raw[turn - 1] != 32]] = True
    edge[turn - 1] = True
    edge[1:-1] |= (blank[1:] & ~blank[:-1]) | _ENDS.ravel()[kind[:-1] * np.uint8(6) + kind[1:]]
    edge |= start
    edge[-1] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    inner = np.concatenate([[0], np.cumsum(kind[1:] == kind[:-1])])  # equal neighbours up to each byte
    lead = (raw[starts] == 32) & (ends - starts > 1)
    first = starts + lead
    single = (kind[first] == _LETTER) & (inner[ends - 1] - inner[first] == ends - 1 - first)
    return cuts, np.searchsorted(offsets, starts, side="right") - 1, single


def load(path: str) -> bytes:
    """The tokenizer file, read on the driver."""
    document = Path(path).read_bytes()
    if len(document) > MAX_FILE_BYTES:
        raise ValueError(f"tokenizer file of {len(document)} bytes; at most {MAX_FILE_BYTES} are broadcast")
    return document


_OPEN: dict[int, Tokenizer] = {}


def _tokenizer(document: bytes) -> Tokenizer:
    """One tokenizer for each worker and file."""
    name = hash(document)
    if name not in _OPEN:
        _OPEN.clear()
        _OPEN[name] = Tokenizer(document)
    return _OPEN[name]


def _encoded(tokenizer: Tokenizer, part: pa.RecordBatch) -> pa.RecordBatch:
    ids, offsets = tokenizer.encode_slice(part.column("text"))
    return pa.RecordBatch.from_arrays([part.column("key"), batches.binary(ids.astype("<u4").view(np.uint8), offsets * 4)], names=["key", "ids"])


def _decoded(tokenizer: Tokenizer, part: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = batches.flat(part.column("ids"))
    text, ends = tokenizer.decode_slice(np.frombuffer(raw.tobytes(), "<u4").astype(np.int64), offsets // 4)
    return pa.RecordBatch.from_arrays([part.column("key"), part.column("ids"), batches.binary(text, ends, pa.string())], names=["key", "ids", "text"])


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids) of every row; ids are packed little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(found):
        tokenizer = _tokenizer(shared.value)
        for batch in found:
            for part in batches.slices(batch, "text", CODE_BYTES):
                yield _encoded(tokenizer, part)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(batches.bounded).mapInArrow(run, f"key {kind}, ids binary").withColumnRenamed("key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, text) of every row of packed ids; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load(path))

    def run(found):
        tokenizer = _tokenizer(shared.value)
        for batch in found:
            for part in batches.slices(batch, "ids", CODE_BYTES):
                yield _decoded(tokenizer, part)

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")).transform(batches.bounded).mapInArrow(run, f"key {kind}, ids binary, text string").withColumnRenamed("key", key)


def recode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids, text) of every row: encoded, and decoded from the packed ids, by one Python worker a task. ``decode`` of
    ``encode`` gives the same with two, which then both stay in memory with a tokenizer each."""
    shared = docs.sparkSession.sparkContext.broadcast(load(path))

    def run(found):
        tokenizer = _tokenizer(shared.value)
        for batch in found:
            for part in batches.slices(batch, "text", CODE_BYTES):
                for coded in batches.slices(_encoded(tokenizer, part), "ids", CODE_BYTES):
                    yield _decoded(tokenizer, coded)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(batches.bounded).mapInArrow(run, f"key {kind}, ids binary, text string").withColumnRenamed("key", key)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of every row, from the ids and the decoded text."""
    back = decode(encode(docs, path, key, text), path, key)
    count = (F.octet_length("ids") / 4).cast("long")
    return back.select(key, count.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
