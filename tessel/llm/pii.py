"""PII: identifiers in plain and in disguised form, with exact source offsets.

Plain identifiers of a text (the base) are found by one pattern for each kind, leftmost and non-overlapping; a match that
fails its kind's test is dropped. Disguised ones are found in a normalised copy: transducers rewrite the text piece by
piece and record for every output character the source characters it stands for.

1. Characters: look-alikes of ASCII (full-width and mathematical forms, Cyrillic and Greek letters, digits of other
   scripts) become ASCII, invisible format characters vanish.
2. Spelled digits: runs of four or more become digits, with "plus" before them as +.
3. Marks: ``[at]``, ``(dot)`` and the like become @ and a dot.
4. Bare words: ``at`` and ``dot`` between blanks become @ and a dot where they make an address: a spelled dot stands by
   (not after "at the" and the like), or a plain domain with a known last label follows and the word before ``at`` is no
   word of prose. ``dot`` between numbers becomes a dot.

Each transducer is one pass over pieces and takes time linear in the text. It records its edits only, with their places
before and after, so a span of the normalised copy is mapped back by binary search, edit list by edit list.

The patterns run again on the normalised copy. A span found there is mapped back to source characters; it is added unless
it overlaps a span of its kind that is there already; base spans always stay. A text without any trigger of a transducer
is its own normal form and is not searched twice.

Not found: spelled numbers above nine, digits that are spelled in part within one group of fewer than four words, and
addresses at a plain domain after a word of prose ("look at example.com").

Defined cases: null counts as empty; empty texts have no spans; very long texts are searched whole; repeated rows give
equal results; an empty table gives an empty result; extra columns do no harm.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import batches
from tessel.sources.tables import table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# A match never starts inside a run of digits: if one failed at its start, it fails inside, too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
# A run of fewer than 16 digits can't be a card, nor hold the start of one.
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn checksum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each @ in order, with the local part before it that no earlier match has taken and the domain after it."""
    found, taken, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            found.append((start, domain.end()))
            taken = domain.end()
        at = text.find("@", max(at + 1, taken))
    return found


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def identifiers(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind in the text, in code points."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = _emails(text)
    if _HAS_DIGIT.search(text):
        if "." in text:
            found["ip"] = [m.span() for m in _IP.finditer(text) if all(int(p) <= 255 for p in m[0].split(".") if len(p.lstrip("0")) <= 3) and all(len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            number = _digits(m[0])
            if len(number) <= 19 and luhn(number):
                found["card"].append(m.span())
        if "+" in text:
            found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


# Letters of other scripts that look like an ASCII letter.
_LOOKALIKES = dict(zip("АВСЕНІЈКМОРЅТХУаеорсухіјѕԁһԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοα", "ABCEHIJKMOPSTXYaeopcyxijsdhqwABEZHIKMNOPTYXoa", strict=True))
# Invisible characters that may be strewn into an identifier.
_INVISIBLE = "­​‌‍⁠﻿"
# Characters used for the at sign, the dot, the plus sign and the hyphen.
_MARKS = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": ".", "＋": "+", "﹢": "+", "‐": "-", "‑": "-", "－": "-", "＿": "_"}


def _character_map() -> dict[str, str]:
    known = dict(_LOOKALIKES) | _MARKS | dict.fromkeys(_INVISIBLE, "")
    blocks = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B), *range(0x1D400, 0x1D800), *range(0x660, 0x66A), *range(0x6F0, 0x6FA), *range(0x966, 0x970)]
    for point in blocks:
        plain = unicodedata.normalize("NFKC", chr(point))
        digit = unicodedata.decimal(chr(point), None)
        if digit is not None:
            known[chr(point)] = str(digit)
        elif len(plain) == 1 and plain.isascii() and plain.isalnum():
            known[chr(point)] = plain
    return known


CHARACTERS = _character_map()
_STRANGE = frozenset(CHARACTERS)

# Spelled digits in the four languages of the corpora.
SPELLED = {
    **dict(zip(("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"), "0123456789", strict=True)),
    **dict(zip(("null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"), "0123456789", strict=True)),
    **dict(zip(("zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"), "0123456789", strict=True)),
    **dict(zip(("cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"), "0123456789", strict=True)),
    "oh": "0", "zwo": "2",
}
_LETTERS = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\s,-]+")
_IS_SPELLED = frozenset([*SPELLED, "plus"]).__contains__
_EDGES = ".,;:!?()[]{}<>\"'/"
#: Spelled digits that make a run.
LEAST_SPELLED = 4

_MARK = re.compile(r"[\[({<]\s*(at|dot|@|\.)\s*[\])}>]", re.IGNORECASE)
_SIGN = {"at": "@", "@": "@", "dot": ".", ".": "."}
_BLANKS = re.compile(r"\s*")
_TRIGGER = re.compile(r"\s(?:at|dot)\s", re.IGNORECASE)
_PIECE = re.compile(r"\S+")
_NAME = re.compile(r"[A-Za-z0-9._%+@-]+")
_NAME_END = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+@-")
_HOST = re.compile(r"[A-Za-z0-9-]+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
# Words after "at" that make it prose.
_AFTER_AT = frozenset(("the", "a", "an", "this", "that", "each", "every", "one"))
# Words before "at" that make it prose where only a plain domain follows.
_BEFORE_AT = frozenset(("us", "me", "him", "her", "them", "it", "you", "look", "looks", "looking", "available", "found", "find", "here", "there", "visit", "online", "hosted", "published", "posted", "page", "pages", "site", "sites", "website", "read", "more", "is", "are", "was", "were", "be", "information", "info", "details", "see", "home", "sold", "shop", "server", "only", "and", "or"))
# Last labels of domains.
_LAST_LABELS = frozenset(("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "io", "co", "me", "eu", "uk", "us", "ca", "au", "de", "at", "ch", "fr", "be", "es", "mx", "ar", "it", "nl", "pl", "pt", "br", "ru", "cn", "jp", "in", "example", "test"))


class Tape:
    """A text with the lists of edits that made it, which lead every place back to the source."""

    def __init__(self, text: str) -> None:
        self.text, self.stages = text, []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace the ordered, disjoint spans (start, end, text). A new character stands for the whole span."""
        if not edits:
            return
        out, at, place = [], 0, 0
        stage: tuple[list[int], ...] = ([], [], [], [])
        for a, b, new in edits:
            out += [self.text[at:a], new]
            place += a - at
            for column, value in zip(stage, (place, place + len(new), a, b), strict=True):
                column.append(value)
            place += len(new)
            at = b
        self.text = "".join([*out, self.text[at:]])
        self.stages.append(stage)

    def source(self, start: int, end: int) -> tuple[int, int]:
        """The source span of text[start:end], which must not be empty."""
        for begins, stops, froms, tos in reversed(self.stages):
            if (k := bisect_right(begins, start) - 1) >= 0:
                start = froms[k] if start < stops[k] else tos[k] + start - stops[k]
            if (k := bisect_right(begins, end - 1) - 1) >= 0:
                end = tos[k] if end - 1 < stops[k] else tos[k] + end - stops[k]
        return start, end


def _spelled(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn runs of spelled digits into digits, one for each word, and drop what parts them."""
    edits: list[tuple[int, int, str]] = []
    run: list[tuple[int, int, str]] = []

    def close() -> None:
        if sum(word != "plus" for _, _, word in run) >= LEAST_SPELLED:
            for k, (a, b, word) in enumerate(run):
                if k:
                    edits.append((run[k - 1][1], a, ""))
                edits.append((a, b, "+" if word == "plus" else SPELLED[word]))
        run.clear()

    for m in _LETTERS.finditer(text):
        a, b = m.span()
        word = m[0].lower() if b - a <= 6 else ""
        # Digits and underscores make a longer word.
        whole = _IS_SPELLED(word) and not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))
        if run and not (whole and (gap := _GAP.match(text, run[-1][1])) and gap.end() == a):
            close()
        if whole:
            run.append((a, b, word))
    close()
    return edits


def _marks(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn bracketed at and dot, with the blanks around them, into @ and a dot."""
    edits, before = [], 0
    for m in _MARK.finditer(text):
        a, b = m.start(), _BLANKS.match(text, m.end()).end()
        while a > before and text[a - 1].isspace():
            a -= 1
        edits.append((a, b, _SIGN[m[1].lower()]))
        before = b
    return edits


def _chains(text: str):
    """Pieces between which only the words at and dot stand: [(piece start, piece end)], [(word, start, end of the blanks
    around it)]. Of the first piece only the end may count, of the last one the beginning; those between are names."""
    pieces = [m.span() for m in _PIECE.finditer(text)]
    words = [text[a:b].lower() if b - a in (2, 3) else "" for a, b in pieces]
    names, links = [], []
    for k in range(1, len(pieces) - 1):
        a, b = pieces[k]
        if words[k] in ("at", "dot") and words[k - 1] not in ("at", "dot") and words[k + 1] not in ("at", "dot"):
            if links and links[-1][3] != k - 2:
                yield names, links
                names, links = [], []
            if links and _NAME.fullmatch(text, *pieces[k - 1]) is None:
                yield names, links
                names, links = [], []
            names = names or [pieces[k - 1]]
            names.append(pieces[k + 1])
            links.append((words[k], pieces[k - 1][1], pieces[k + 1][0], k))
    if links:
        yield names, links


def _bare(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn the bare words at and dot into @ and a dot where they make an address or a number."""
    edits: list[tuple[int, int, str]] = []
    for names, links in _chains(text):
        a, b = names[0]
        begin = b
        while begin > a and text[begin - 1] in _NAME_END:
            begin -= 1
        parts = [text[begin:b], *(text[x:y] for x, y in names[1:])]
        hosts = [_HOST.match(p) for p in parts]
        used = [False] * len(links)
        spelled_at = [word == "at" for word, *_ in links]
        # Places where an address's host begins: after a spelled at, or after an @ inside a name.
        for k, part in enumerate(parts):
            if k and spelled_at[k - 1]:
                local, host = parts[k - 1], part
            elif "@" in part:
                local, _, host = part.rpartition("@")
            else:
                continue
            left, right = k - 1 - (k > 0 and spelled_at[k - 1]), k
            while left >= 0 and not spelled_at[left] and not used[left] and (left + 1 == k or "@" not in parts[left + 1]):
                left -= 1
            # A host goes on over spelled dots while its pieces are whole labels.
            while right < len(links) and not spelled_at[right] and hosts[right + 1] and "@" not in parts[right + 1]:
                right += 1
            dots = [j for j in range(left + 1, right) if not spelled_at[j]]
            found = _DOMAIN.match(host)
            domain = found or (right > k and _HOST.match(host))
            if not local or not domain:
                continue
            plain = found is not None and found[0].rpartition(".")[2].lower() in _LAST_LABELS and "@" not in part and local.lower() not in _BEFORE_AT
            if (dots and host.lower() not in _AFTER_AT) or (not dots and plain):
                for j in [*dots, *([k - 1] if k and spelled_at[k - 1] else [])]:
                    used[j] = True
        for j, (word, *_) in enumerate(links):
            if word == "dot" and not used[j]:
                before, after = parts[j].rpartition("@")[2], _NUMBERS.match(parts[j + 1])
                used[j] = bool(before and after and _NUMBERS.fullmatch(before))
        edits += [(links[j][1], links[j][2], _SIGN[links[j][0]]) for j in range(len(links)) if used[j]]
    return edits


def normalise(text: str) -> Tape | None:
    """The normalised copy with its offsets, or None where no transducer has anything to do."""
    low = text.lower()
    mark, bare = _MARK.search(text) is not None, _TRIGGER.search(text) is not None
    # A run of four spelled digits has two in a row, or joined by a hyphen or a comma.
    spelled = b"\1\1" in bytes([_IS_SPELLED(w.strip(_EDGES)) for w in low.replace(",", " ").replace("-", " ").split()])
    strange = not text.isascii() and not _STRANGE.isdisjoint(text)
    if not (mark or bare or spelled or strange):
        return None
    tape = Tape(text)
    if strange:
        tape.rewrite([(i, i + 1, CHARACTERS[c]) for i, c in enumerate(text) if c in _STRANGE])
    if strange or spelled:
        tape.rewrite(_spelled(tape.text))
    if strange or mark:
        tape.rewrite(_marks(tape.text))
    if strange or mark or bare:
        tape.rewrite(_bare(tape.text))
    return tape if tape.stages else None


def detect(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) as (kind, start, end) in code points of the source, by kind and then by start."""
    base = identifiers(text)
    everything = {k: list(v) for k, v in base.items()}
    if (tape := normalise(text)) is not None:
        for kind, spans in identifiers(tape.text).items():
            starts, last, more = [a for a, _ in base[kind]], 0, []
            for start, end in (tape.source(a, b) for a, b in spans):  # ascending, as the tape keeps the order
                k = bisect_right(starts, start)
                free = (not k or base[kind][k - 1][1] <= start) and (k == len(starts) or starts[k] >= end)
                if free and start >= last:
                    more.append((start, end))
                    last = end
            everything[kind] += more
    flat = lambda found: [(k, a, b) for k in KINDS for a, b in sorted(found[k])]
    return flat(base), flat(everything)


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, spans) of every row: arrays of (kind, start, end) of the plain identifiers and of all."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, "text"):
                both = [detect(t or "") for t in part.column("text").to_pylist()]
                columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in b[i]] for b in both], _SPAN) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *columns], names=["key", "base", "spans"])

    span = "array<struct<kind string, start bigint, end bigint>>"
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).transform(batches.bounded).mapInArrow(run, f"key {kind}, base {span}, spans {span}").withColumnRenamed("key", key)


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first stands for all."""
    out, at = [], 0
    for start, end, kind in sorted((a, -b, k) for k, a, b in spans):
        end = -end
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns kept, with every identifier replaced by ``<kind>``; a null text stays null."""

    def run(found):
        for batch in found:
            for part in batches.slices(batch, text):
                at = part.schema.get_field_index(text)
                new = [t if t is None else redact_text(t, detect(t)[1]) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.transform(batches.bounded).mapInArrow(run, docs.schema)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def span_digest(text: str) -> tuple:
    """The registered query's row of one text, for tests."""
    base, spans = detect(text)
    counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
    return (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.col("base.kind"), lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), added)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbers of plain identifiers alone."""
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.size(F.filter(F.col("base.kind"), lambda kind: kind == F.lit(k))).cast("long").alias(f"n_{k}") for k in KINDS])


BASE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), m AS (
  SELECT doc_id, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone FROM d
)
SELECT doc_id, len(email)::BIGINT AS n_email,
  len(list_filter(ip, lambda x: list_bool_and(list_transform(string_split(x, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) <= 255))))::BIGINT AS n_ip,
  len(list_filter(card, lambda x: length(x) BETWEEN 16 AND 19 AND list_sum(list_transform(range(length(x)), lambda i: CASE WHEN i % 2 = 0 THEN x[length(x) - i]::INTEGER ELSE x[length(x) - i]::INTEGER * 2 - CASE WHEN x[length(x) - i]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phone, lambda x: length(x) BETWEEN 8 AND 15))::BIGINT AS n_phone FROM m
"""
