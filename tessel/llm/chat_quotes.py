"""Quotation linking: who replies to whom, read from quoted passages, and conversations in reply order without quotes.

A line's quote level is its number of leading ``>`` (blanks between them allowed). A passage is a run of lines of one
level above 0 in a message. Lines are normalised (lower case, white space collapsed, markers gone); a passage's hash is
that of its lines joined by blanks, so a quotation that was wrapped anew keeps it. What a message wrote itself at level 0,
without attribution lines, is hashed whole, by paragraph (lines between blank or quoted ones) and by line.

A passage's original is the latest earlier turn of its conversation that wrote a whole text, paragraph or line with the
passage's hash. Where there is none, each line of the passage links to the latest earlier turn that wrote that line, and
the original is the turn that most lines link to, the later turn at a tie. A message's parent is the original of its first
linked passage of level 1; its ``thread`` is the first turn reached along parents. Reply order sorts threads by their first
turn and turns within a thread.

How it scales: all JVM expressions. Only conversations that quote anything are spread into hashes. Asked and written hashes
meet in windows over blocks of ``BLOCK`` turns of one (conversation, hash), and a window over the blocks' latest turns
carries on, so neither a line that occurs everywhere nor a hot conversation makes one task's work, and pairs never form;
hashes are made distinct first, which also folds copies. Chains of replies are followed by doubling, so a chain of n
replies takes log2(n) small joins over linked messages alone. Positions come from a range sort of all rows by conversation,
thread and turn and from counts of each conversation in each range, so no conversation or thread is numbered in one task.

Defined cases: null text counts as empty; a null conversation or turn gets no links; a quotation that no earlier message
wrote is removed but links nothing; of repeated (conversation, turn) all texts count as written there and all replies found
are its links; repeated rows are each kept, with equal links, in any order; an empty table gives an empty result; extra
columns do no harm. Turns must be integers or castable to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.session import checkpoint, release
from tessel.sources.tables import table

MARK = r"^[ \t]*>"
MARKS = r"^(?:[ \t]*>)+[ \t]?"
#: A line such as "On Monday, Ann wrote:" just before a quotation goes with the quotation.
ATTRIBUTION = r"(?i)^.*(?:wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$"
#: Turns of a block in which asked and written hashes meet.
BLOCK = 10_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r?\n", -1)


def quote_level(line: Column) -> Column:
    """Number of leading quote marks of a line."""
    return F.length(F.translate(F.regexp_extract(line, MARKS, 0), " \t", ""))


def normal(line: Column) -> Column:
    """A line's normal form; empty for a blank line."""
    return F.lower(F.btrim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"(?U)\s+", " ")))


def _own_lines(text: Column) -> Column:
    """A text's lines without quoted ones and without the attribution lines before them."""
    lines = _lines(text)
    return F.filter(lines, lambda line, i: ~line.rlike(MARK) & ~(line.rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1).rlike(MARK), F.lit(False))))


def without_quotes(text: Column) -> Column:
    """The text without quoted lines and without the attribution lines before them."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"(?m)" + MARK), F.btrim(F.array_join(_own_lines(text), "\n"), F.lit(" \n\r\t"))).otherwise(text)


def written_hashes(text: Column) -> Column:
    """The distinct hashes of what a message wrote itself: whole, by paragraph and by line."""
    lines = _lines(text)
    # Quoted and attribution lines become empty and so end a paragraph.
    own = F.transform(lines, lambda line, i: F.when(line.rlike(MARK) | (line.rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1).rlike(MARK), F.lit(False))), F.lit("")).otherwise(normal(line)))
    paragraphs = F.transform(F.split(F.array_join(own, "\n"), "\n\n+", -1), lambda p: F.btrim(F.translate(p, "\n", " ")))
    whole = F.array(F.array_join(F.filter(own, lambda line: line != ""), " "))
    return F.transform(F.filter(F.array_distinct(F.concat(own, paragraphs, whole)), lambda unit: unit != ""), lambda unit: F.sha2(unit, 256))


def passages(messages: DataFrame) -> DataFrame:
    """(conv, turn, message, passage, level, lines, hash, line_hashes) of every quoted passage of messages (conv, turn, text):
    its number of lines, the hash of all of it (null if blank), and those of its lines that aren't blank."""
    quoting = messages.filter(F.col("text").rlike(r"(?m)" + MARK) & F.col("conv").isNotNull() & F.col("turn").isNotNull())
    lines = quoting.distinct().withColumn("message", F.sha2("text", 256)).select("conv", "turn", "message", F.posexplode(_lines(F.col("text"))).alias("line", "content"))
    levelled = lines.withColumn("level", quote_level(F.col("content")))
    order = Window.partitionBy("conv", "turn", "message").orderBy("line")
    starts = F.when(F.col("level") != F.coalesce(F.lag("level").over(order), F.lit(-1)), 1).otherwise(0)
    numbered = levelled.withColumn("starts", starts).withColumn("passage", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    own = numbered.filter("level > 0").groupBy("conv", "turn", "message", "passage", "level").agg(F.array_sort(F.collect_list(F.struct("line", normal(F.col("content")).alias("text")))).alias("found"))
    solid = F.filter(F.col("found.text"), lambda line: line != "")
    return own.select("conv", "turn", "message", "passage", "level", F.size("found").alias("lines"), solid.alias("solid")).select(
        "conv", "turn", "message", "passage", "level", "lines", F.when(F.size("solid") > 0, F.sha2(F.array_join("solid", " "), 256)).alias("hash"), F.transform("solid", lambda line: F.sha2(line, 256)).alias("line_hashes")
    )


def latest_earlier(asked: DataFrame, written: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, hash, turn, original) of distinct asked (conv, hash, turn): the latest turn before it that wrote the hash."""
    events = asked.withColumn("source", F.lit(None).cast("bigint")).unionByName(written.select("conv", "hash", "turn", F.col("turn").alias("source")))
    events = events.withColumn("block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv", "hash", "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    met = events.withColumn("near", F.max("source").over(inside)).filter("source IS NULL").drop("source")
    # What the blocks before hold: one row for each block of a hash.
    before = Window.partitionBy("conv", "hash").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = events.groupBy("conv", "hash", "block").agg(F.max("source").alias("latest")).withColumn("far", F.max("latest").over(before)).filter("far IS NOT NULL")
    far = blocks.select(F.col("conv").alias("b_conv"), F.col("hash").alias("b_hash"), F.col("block").alias("b_block"), "far")
    joined = met.join(far, (F.col("conv") == F.col("b_conv")) & (F.col("hash") == F.col("b_hash")) & (F.col("block") == F.col("b_block")), "left")
    return joined.select("conv", "hash", "turn", F.coalesce("near", "far").alias("original"))


def link(messages: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, turn, message, passage, level, lines, matched, original) of every quoted passage of messages (conv, turn, text);
    matched is the number of its lines that link: all that aren't blank if the whole passage does."""
    quoted = passages(messages)
    written = messages.join(quoted.select(F.col("conv").alias("q_conv")).distinct(), F.col("conv") == F.col("q_conv"), "left_semi").filter(F.col("turn").isNotNull())
    written = written.select("conv", "turn", F.explode(written_hashes(F.col("text"))).alias("hash")).distinct()
    spread = quoted.select("conv", "turn", "message", "passage", F.explode(F.concat(F.array(F.struct("hash", F.lit(True).alias("whole"))), F.transform("line_hashes", lambda h: F.struct(h.alias("hash"), F.lit(False).alias("whole"))))).alias("unit"))
    spread = spread.select("conv", "turn", "message", "passage", "unit.*").filter("hash IS NOT NULL")
    found = latest_earlier(spread.select("conv", "hash", "turn").distinct(), written, block).filter("original IS NOT NULL")
    keys = ["conv", "turn", "message", "passage"]
    votes = spread.join(found, ["conv", "hash", "turn"]).groupBy(*keys, "original").agg(F.max("whole").alias("whole"), F.sum((~F.col("whole")).cast("bigint")).alias("votes"))
    best = votes.groupBy(*keys).agg(F.max(F.struct("whole", "votes", "original")).alias("best"))
    matched = F.when(F.col("best.whole"), F.size("line_hashes")).otherwise(F.coalesce("best.votes", F.lit(0)))
    return quoted.join(best, keys, "left").select(*keys, "level", "lines", matched.cast("bigint").alias("matched"), F.col("best.original").alias("original"))


def threads(links: DataFrame) -> DataFrame:
    """(conv, turn, parent, thread, depth) of every linked message, by pointer doubling along parents."""
    first = F.min(F.when((F.col("level") == 1) & F.col("original").isNotNull(), F.struct("passage", "original")))
    parents = links.groupBy("conv", "turn").agg(first.alias("first")).filter("first IS NOT NULL")
    jumps = checkpoint(parents.select("conv", "turn", F.col("first.original").alias("parent"), F.col("first.original").alias("thread"), F.lit(1).alias("depth")))
    while not jumps.isEmpty():
        far = jumps.select(F.col("conv").alias("f_conv"), F.col("turn").alias("f_turn"), F.col("thread").alias("f_thread"), F.col("depth").alias("f_depth"))
        joined = jumps.join(far, (F.col("conv") == F.col("f_conv")) & (F.col("thread") == F.col("f_turn")), "left")
        ahead = checkpoint(joined.select("conv", "turn", "parent", F.coalesce("f_thread", "thread").alias("thread"), (F.col("depth") + F.coalesce("f_depth", F.lit(0))).alias("depth"), F.col("f_turn").isNotNull().alias("moved")))
        release(jumps)
        jumps = ahead
        if jumps.filter("moved").isEmpty():
            break
    return jumps.select("conv", "turn", "parent", "thread", "depth")


def reply_order(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple[str, ...] = ("role",)) -> DataFrame:
    """(conv, turn, *keep, parent_turn, thread_turn, depth, position, n_quoted, n_linked, text) of every message."""
    rows = conversations.select(F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(text).alias("text"), F.struct(*keep).alias("kept"))
    messages = rows.select("conv", "turn", "text")
    links = checkpoint(link(messages))
    counts = links.groupBy("conv", "turn", "message").agg(F.sum("lines").alias("n_quoted"), F.sum("matched").alias("n_linked"))
    placed = rows.withColumn("message", F.when(F.col("text").rlike(r"(?m)" + MARK), F.sha2("text", 256))).join(threads(links), ["conv", "turn"], "left").join(counts, ["conv", "turn", "message"], "left")
    placed = placed.withColumn("thread", F.coalesce("thread", "turn"))
    # Positions: the place in a range sort, less the places before the conversation's first row in that range, plus its
    # rows in the ranges before.
    ordered = placed.orderBy("conv", "thread", "turn", F.xxhash64("text"), "kept").withColumn("place", F.monotonically_increasing_id())
    ordered = checkpoint(ordered.withColumn("part", F.shiftright("place", 33)))
    parts = ordered.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(F.col("conv").alias("o_conv"), F.col("part").alias("o_part"), (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first") + 1).alias("offset"))
    joined = ordered.join(offsets, F.col("conv").eqNullSafe(F.col("o_conv")) & (F.col("part") == F.col("o_part")))
    return joined.select(
        F.col("conv").alias(conv), F.col("turn").alias(turn), *[F.col("kept")[c].alias(c) for c in keep],
        F.col("parent").alias("parent_turn"), F.col("thread").alias("thread_turn"), F.coalesce("depth", F.lit(0)).alias("depth"),
        (F.col("offset") + F.col("place")).alias("position"), F.coalesce("n_quoted", F.lit(0)).alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), without_quotes(F.col("text")).alias("text"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_order(table(spark, sf_dir, "conversations"))


_SQL_OWN = r"""list_transform(ls, lambda x, i: CASE WHEN regexp_matches(x, '^[ \t]*>') OR (regexp_matches(x, '(?i)^.*(?:wrote|writes|schrieb|a écrit|escribió) ?:[ \t]*$')
    AND coalesce(regexp_matches(ls[i + 1], '^[ \t]*>'), false)) THEN NULL ELSE x END)"""
_SQL_NORMAL = r"lower(trim(regexp_replace(regexp_replace({}, '^(?:[ \t]*>)+[ \t]?', ''), '[\s\v\x{{85}}\p{{Z}}]+', ' ', 'g'), ' '))"

ORACLE_SQL = rf"""
WITH RECURSIVE m AS (
  SELECT conv_id AS conv, turn, role, text, regexp_matches(coalesce(text, ''), '(?m)^[ \t]*>') AS quotes, string_split_regex(coalesce(text, ''), '\r?\n') AS ls FROM conversations
), d AS (SELECT DISTINCT conv, turn, text, quotes, ls FROM m WHERE conv IS NOT NULL AND turn IS NOT NULL
), l AS (
  SELECT conv, turn, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d WHERE quotes
), v AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^(?:[ \t]*>)+[ \t]?'), '[ \t]', '', 'g')) AS level, {_SQL_NORMAL.format("line")} AS content FROM l
), n AS (
  SELECT *, i - row_number() OVER (PARTITION BY conv, turn, text, level ORDER BY i) AS run FROM v
), p AS (
  SELECT conv, turn, text, level, run, min(i) AS passage, count(*) AS n_lines, list(content ORDER BY i) FILTER (content <> '') AS solid
  FROM n WHERE level > 0 GROUP BY ALL
), o AS (
  SELECT conv, turn, text, {_SQL_OWN} AS own FROM d
), c AS (
  SELECT conv, turn, list_transform(own, lambda x: CASE WHEN x IS NULL THEN '' ELSE {_SQL_NORMAL.format("x")} END) AS own FROM o
), w AS (
  SELECT DISTINCT conv, turn, unit FROM (
    SELECT conv, turn, unnest(own) AS unit FROM c
    UNION ALL SELECT conv, turn, trim(replace(unnest(string_split_regex(array_to_string(own, chr(10)), '\n\n+')), chr(10), ' '), ' ') FROM c
    UNION ALL SELECT conv, turn, array_to_string(list_filter(own, lambda x: x <> ''), ' ') FROM c
  ) WHERE unit <> ''
), a AS (
  SELECT conv, turn, text, passage, array_to_string(solid, ' ') AS unit, true AS whole FROM p WHERE solid IS NOT NULL
  UNION ALL SELECT conv, turn, text, passage, unnest(solid), false FROM p
), f AS (
  SELECT a.conv, a.turn, a.text, a.passage, a.whole, a.unit, max(w.turn) AS original, any_value(n) AS n
  FROM (SELECT conv, turn, text, passage, whole, unit, count(*) AS n FROM a GROUP BY ALL) a
  JOIN w ON a.conv = w.conv AND a.unit = w.unit AND w.turn < a.turn GROUP BY ALL
), g AS (
  SELECT conv, turn, text, passage, original, bool_or(whole) AS whole, sum(CASE WHEN whole THEN 0 ELSE n END) AS votes FROM f GROUP BY ALL
), b AS (
  SELECT conv, turn, text, passage, max({{'whole': whole, 'votes': votes, 'original': original}}) AS best FROM g GROUP BY ALL
), k AS (
  SELECT p.*, b.best.original AS original, CASE WHEN b.best.whole THEN len(solid) ELSE coalesce(b.best.votes, 0) END AS matched
  FROM p LEFT JOIN b USING (conv, turn, text, passage)
), s AS (
  SELECT conv, turn, text, sum(n_lines) AS n_quoted, sum(matched) AS n_linked FROM k GROUP BY ALL
), parents AS (
  SELECT conv, turn, arg_min(original, passage) AS parent FROM
    (SELECT conv, turn, passage, min(original) AS original FROM k WHERE level = 1 AND original IS NOT NULL GROUP BY ALL) GROUP BY ALL
), up AS (
  SELECT conv, turn, parent, parent AS thread, 1 AS depth FROM parents
  UNION ALL SELECT up.conv, up.turn, up.parent, q.parent, depth + 1 FROM up JOIN parents q ON up.conv = q.conv AND up.thread = q.turn
), t AS (
  SELECT conv, turn, parent, arg_max(thread, depth) AS thread, max(depth) AS depth FROM up GROUP BY ALL
)
SELECT m.conv AS conv_id, m.turn, m.role, t.parent AS parent_turn, coalesce(t.thread, m.turn) AS thread_turn, coalesce(t.depth, 0)::INTEGER AS depth,
  row_number() OVER (PARTITION BY m.conv ORDER BY coalesce(t.thread, m.turn) NULLS FIRST, m.turn NULLS FIRST, m.text NULLS FIRST) AS position,
  coalesce(s.n_quoted, 0)::BIGINT AS n_quoted, coalesce(s.n_linked, 0)::BIGINT AS n_linked,
  CASE WHEN m.quotes THEN trim(array_to_string(list_filter({_SQL_OWN}, lambda x: x IS NOT NULL), chr(10)), E' \n\r\t') ELSE m.text END AS text
FROM m LEFT JOIN t ON m.conv = t.conv AND m.turn = t.turn LEFT JOIN s ON m.conv = s.conv AND m.turn = s.turn AND m.text = s.text
"""
