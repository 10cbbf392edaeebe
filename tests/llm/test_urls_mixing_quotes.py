import collections
import hashlib
import itertools
import random
import re

import pytest

from tessel.llm import chat_quotes, source_mixing, url_filters

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"), ("block", "example.org"), ("allow", "a.example.org/x/y"), ("block", "com/de"))
URLS = [
    None, "", "no scheme", "http://", "http://NET", "http://net/", "http://Sub.Net/x", "https://example.net/en/1", "https://example.net/en", "https://www.EXAMPLE.net/en/?q#f", "x://example.com/de/", "x://example.com/debug/",
    "x://notexample.com/de/", "x://fr.org/fr/1", "x://example.org", "x://a.example.org/x/yz", "x://a.example.org/x/", "x://b.a.example.org/x/y/z", "a://b://example.net/en/", "x://example.net:80/en/", "x://u@example.net/en/#/de/", "x://example.net?/en/",
]


def brute(url, rules, default="allow"):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([i for i in map(tail.find, "?#") if i >= 0], default=len(tail))]
    best = None
    for verdict, rule in rules:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            best = max(best or (0,), (len(rule), len(h), rule, verdict))
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_rules(spark, limit):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*URLS, URLS[6]])], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages, RULES, broadcast_bytes=limit).collect()}
    assert got == {i: brute(u, RULES) for i, u in enumerate([*URLS, URLS[6]])}
    assert url_filters.judge(pages.limit(0), RULES, broadcast_bytes=limit).collect() == []


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_url_rules_under_both_verdicts(spark, limit):
    """A rule that is listed twice has one verdict, whatever the order and the size of the list."""
    rules = (("block", "a.com/x/"), ("allow", "a.com/x/"), ("allow", "b.com/y"), ("block", "b.com/y"), ("allow", "b.com/yy"))
    urls = ["x://a.com/x/1", "x://b.com/y", "x://b.com/yy/", "x://b.com/yz", "x://c.a.com/x/1", "x://a.com/x/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, rules, broadcast_bytes=limit).collect()}
    assert got == {0: ("a.com/x/", "block"), 1: ("b.com/y", "block"), 2: ("b.com/yy", "allow"), 3: ("b.com/y", "block"), 4: ("a.com/x/", "block"), 5: ("a.com/x/", "block")}


def test_many_path_rules_of_one_host():
    trie = url_filters.HostPathTrie([("block", f"a.com/{i:06}") for i in range(100_000)])
    assert trie.find("w.a.com", "/054321/x") == ("a.com/054321", "block") and trie.find("a.com", "/x") is None
    *_, path = [trie.root] + [trie.root["next"]["com"]["next"]["a"]["paths"]["next"][""]]
    assert path["lengths"] == {6}


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Water filling round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while open_:
        full = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > cap * sizes[s]}
        if not full:
            for s in open_:
                out[s] = left * weight[s] / sum(weight[x] for x in open_)
            return out
        for s in full:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


def test_mixing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)) if i % 9 else None, rng.choice(["a", "b", "c", "B", "é", None])) for i in range(300)] + [(7, "a b c", "only"), (7, "a b c", "only"), (None, "x y", "a"), (900, "", "void")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "2 AS key", "3 AS row")
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets(sizes)
    got = source_mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 and r.source_size == sizes[s] and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[s]) < 1
        key = lambda r: (hashlib.md5(str("null " + hashlib.md5(b"x y").hexdigest() if r.id is None else r.id).encode()).hexdigest(), r.id if r.id is not None else -1, r.size)
        budget, order = int(want[s] + 1e-9), sorted(own, key=key)
        epochs = budget // sizes[s] if sizes[s] else 0
        left, expected = budget - epochs * sizes[s], []
        for r in order:
            expected.append(epochs * r.size + min(r.size, left))
            left -= min(r.size, left)
        assert sorted(expected) == sorted(r.taken for r in own)
    assert sorted(map(str, source_mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    made = source_mixing.materialise(docs).collect()
    assert sum(len(r.text.split()) for r in made) == sum(r.taken for r in got) and all(r.text for r in made)
    assert source_mixing.mix(docs.limit(0)).collect() == [] and source_mixing.materialise(docs.limit(0)).collect() == []


CHAT = [
    (1, 0, "First line here\nsecond line"), (1, 1, "> first   LINE here\n> second line\nI agree"), (1, 2, "Unrelated"), (1, 3, "On Monday, Ann wrote:\n> I agree\n>> second line\nWhy?\n>\n> nobody wrote this"), (1, 4, "> Why?\nBecause"),
    (2, 0, "I agree"), (2, 1, None), (2, 2, "a > b is no quote"), (None, 0, "> x"), (3, 0, "dup"), (3, 1, "dup"), (3, 2, "> dup\nok"), (3, 2, "> dup\nok"),
]


def test_quotes(spark):
    table = spark.createDataFrame([(c, t, "user", x) for c, t, x in CHAT], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS hash", "2 AS depth")
    got = chat_quotes.reply_order(table).collect()
    assert len(got) == len(CHAT)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].parent_turn for t in range(5)] == [None, 0, None, 1, 3]
    assert [by[1, t].thread_turn for t in range(5)] == [0, 0, 2, 0, 0] and [by[1, t].depth for t in range(5)] == [0, 1, 0, 2, 3]
    assert [by[1, t].position for t in range(5)] == [1, 2, 5, 3, 4]
    assert [by[1, t].text for t in range(5)] == ["First line here\nsecond line", "I agree", "Unrelated", "Why?", "Because"]
    assert (by[1, 3].n_quoted, by[1, 3].n_linked) == (4, 2)
    assert by[2, 1].text is None and by[2, 2].text == "a > b is no quote" and by[None, 0].parent_turn is None
    assert by[3, 2].parent_turn == 1 and sorted(r.position for r in got if r.conv_id == 3) == [1, 2, 3, 4]
    assert chat_quotes.reply_order(table.limit(0)).collect() == []


def test_long_chains_of_replies(spark):
    rows = [(5, i, "user", (f"> line {i - 1}\n" if i else "") + f"line {i}") for i in range(40)]
    got = chat_quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert all(r.thread_turn == 0 and r.depth == r.turn and r.position == r.turn + 1 for r in got)


ATTRIBUTED = re.compile(r"(?i).*(wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*")


def brute_chat(rows):
    """Links, threads and reply order of (conv, turn, role, text), message by message."""
    level = lambda line: len(m[0].replace(" ", "").replace("\t", "")) if (m := re.match(r"([ \t]*>)+", line)) else 0
    normal = lambda line: " ".join(re.sub(r"^([ \t]*>)+", "", line).lower().split())
    split = lambda text: re.split("\r?\n", text or "")
    wrote, own = {}, {}
    for conv, turn, _, text in rows:
        lines = split(text)
        mine = [None if level(x) or (ATTRIBUTED.fullmatch(x) and i + 1 < len(lines) and level(lines[i + 1])) else x for i, x in enumerate(lines)]
        own[text] = "\n".join(x for x in mine if x is not None).strip(" \n\r\t") if any(map(level, lines)) else text
        clean = ["" if x is None else normal(x) for x in mine]
        paragraphs = [" ".join(g) for solid, g in itertools.groupby(clean, bool) if solid]
        for unit in {*clean, *paragraphs, " ".join(x for x in clean if x)} - {""}:
            wrote.setdefault((conv, unit), set()).add(turn)
    counts, firsts = {}, {}
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        runs = [(k, [normal(x) for x in g]) for k, g in itertools.groupby(split(text), level)]
        quoted = linked = 0
        for place, (k, lines) in enumerate(runs):
            if not k:
                continue
            solid = [x for x in lines if x]
            quoted += len(lines)
            earlier = lambda unit: max((t for t in wrote.get((conv, unit), ()) if t is not None and t < turn), default=None)  # noqa: E731, B023
            original = earlier(" ".join(solid)) if solid else None
            if original is not None:
                linked += len(solid)
            else:
                votes = collections.Counter(t for x in solid if (t := earlier(x)) is not None)
                if votes:
                    number, original = max((n, t) for t, n in votes.items())
                    linked += number
            if k == 1 and original is not None:
                firsts.setdefault((conv, turn), set()).add((place, original))
        counts[conv, turn, text] = quoted, linked
    parent = {k: min(v)[1] for k, v in firsts.items()}
    out = []
    for conv, turn, role, text in rows:
        thread, depth = turn, 0
        while (conv, thread) in parent:
            thread, depth = parent[conv, thread], depth + 1
        out.append([conv, turn, role, parent.get((conv, turn)), thread, depth, *counts.get((conv, turn, text), (0, 0)), own[text]])
    return sorted(map(str, out))


def chats(seed, repeats):
    """Random conversations that quote whole texts, paragraphs, wrapped passages and single lines, nested and made up."""
    rng, rows = random.Random(seed), [(None, 1, "a", "> x"), (7, None, "a", "> x\ny"), (7, 1, "b", None), (7, 2, "b", "")]
    stock = [" ".join(rng.choice(["alpha", "Beta", "gamma  delta", "é"]) for _ in range(rng.randrange(1, 4))) for _ in range(9)]
    for conv in range(6):
        texts = []
        for turn in range(rng.randrange(2, 25)):
            parts = []
            for _ in range(rng.randrange(3)):
                if not texts:
                    break
                kind, old = rng.randrange(5), rng.choice(texts).split("\n")
                if kind == 0:
                    old = old[rng.randrange(len(old)) :]
                elif kind == 1:
                    old = [" ".join(x.strip() for x in old if not x.startswith(">"))]
                elif kind == 2:
                    old = [rng.choice(old), "made up " + str(rng.random()), rng.choice(stock)]
                parts += rng.choice([[], ["Ann wrote:"], ["On " + "x" * 300 + " Bob schrieb :"]]) + [rng.choice(["> ", ">", " > "]) + x for x in old] + rng.choice([[], [""]])
            parts += [rng.choice([*stock, "", "own " + str(rng.randrange(30))]) for _ in range(rng.randrange(4))]
            texts.append("\n".join(parts))
            rows.append((conv, turn, rng.choice("ab"), texts[-1]))
            if repeats and rng.random() < 0.2:
                rows.append((conv, turn, "b", rng.choice([texts[-1], "> " + stock[0] + "\nand more"])))
    return rows


@pytest.mark.parametrize(("seed", "repeats"), [(1, False), (2, False), (3, True), (4, True)])
def test_quotes_against_a_brute_force_linker(spark, seed, repeats, monkeypatch):
    monkeypatch.setattr(chat_quotes.link, "__defaults__", (4,))  # small blocks of turns
    rows = chats(seed, repeats)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat_quotes.reply_order(table).collect()
    columns = ("conv_id", "turn", "role", "parent_turn", "thread_turn", "depth", "n_quoted", "n_linked", "text")
    assert sorted(str([r[c] for c in columns]) for r in got) == brute_chat(rows)
    assert any(r.depth > 2 for r in got) and any(0 < r.n_linked < r.n_quoted for r in got)
    for conv in {r.conv_id for r in got}:
        order = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in order] == list(range(1, len(order) + 1))
        keys = [(r.thread_turn is not None, r.thread_turn, r.turn is not None, r.turn) for r in order]
        assert keys == sorted(keys, key=lambda k: tuple((x is not None, x) for x in k))


def test_quotes_against_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = chats(5, False)
    with duckdb.connect() as db:
        db.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        db.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
        cursor = db.execute(chat_quotes.ORACLE_SQL)
        names = [c[0] for c in cursor.description]
        want = sorted(str(dict(zip(names, r, strict=True))) for r in cursor.fetchall())
    got = chat_quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*names).collect()
    assert sorted(str(r.asDict()) for r in got) == want
