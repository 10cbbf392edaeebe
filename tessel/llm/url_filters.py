"""URL filters: allow and block rules in a trie over reversed host labels and path segments.

A rule is ``host/path``. It fits its host and every subdomain when the url's path starts with the rule's path; of all
rules that fit, the longest rule text wins (at equal length the one with the longer host). A rule that is listed under
several verdicts counts once, as the greatest of them by code point, so ``block`` beats ``allow``. A url without any
fitting rule gets the default verdict.

Defined cases: a null url and one without ``://`` have an empty host and path and get the default verdict; an empty
table gives an empty result; repeated rows are judged one by one; extra columns of the input do not matter.

The trie is broadcast only while its rules stay under ``broadcast_bytes``. Beyond that the rules are kept as a table and
joined by equality on (host suffix, path prefix): a distinct host and path has as many of those pairs as labels times
segments times lengths that the last pieces of rules have. Both ways give the same verdicts.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import batches
from tessel.sources.tables import table

#: The rule list of the registered query: (verdict, host/path).
RULES = (
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
)

#: Rules beyond this many bytes of text are joined instead of broadcast.
BROADCAST_BYTES = 16 << 20


def distinct_rules(rules) -> dict[str, str]:
    """The verdict of each rule text."""
    found: dict[str, str] = {}
    for verdict, rule in rules:
        found[rule] = max(verdict, found.get(rule, verdict))
    return found


class HostPathTrie:
    """Reversed host labels lead to nodes; each node holds a second trie of whole path segments.

    A path rule ends inside a segment (``/en/`` ends with an empty one), so its last piece is kept as a prefix at the
    node of the segments before it, found by its length: a url's segment is cut to each length that any of them has.
    """

    def __init__(self, rules) -> None:
        self.root: dict = {"next": {}, "paths": None}
        for rule, verdict in distinct_rules(rules).items():
            host, slash, rest = rule.partition("/")
            node = self.root
            for label in reversed(host.split(".")):
                node = node["next"].setdefault(label, {"next": {}, "paths": None})
            path = node["paths"] = node["paths"] or {"next": {}, "ends": {}, "lengths": set()}
            *whole, last = (slash + rest).split("/")
            for segment in whole:
                path = path["next"].setdefault(segment, {"next": {}, "ends": {}, "lengths": set()})
            path["ends"][last] = len(rule), len(host), rule, verdict
            path["lengths"].add(len(last))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest fitting rule, else None."""
        best, node, segments = None, self.root, path.split("/")
        for label in reversed(host.split(".")):
            node = node["next"].get(label)
            if node is None:
                break
            step = node["paths"]
            for segment in segments:
                if step is None:
                    break
                for length in step["lengths"]:
                    found = step["ends"].get(segment[:length]) if length <= len(segment) else None
                    if found and (best is None or found[:2] > best[:2]):
                        best = found
                step = step["next"].get(segment)
        return best and best[2:]


def with_host_and_path(df: DataFrame, url: str) -> tuple[Column, Column]:
    """Host and path columns of a url column, in JVM expressions."""
    text = F.coalesce(F.col(url), F.lit(""))
    cut = F.when(F.instr(text, "://") > 0, F.substr(text, F.instr(text, "://") + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(cut, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(cut, r"^[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) of every row of ``df``."""
    host, path = with_host_and_path(df, url)
    parsed = df.select(F.col(key), host.alias("host"), path.alias("path"))
    if sum(len(rule) for _, rule in rules) > broadcast_bytes:
        return _by_join(parsed, rules, key, default)
    trie = df.sparkSession.sparkContext.broadcast(HostPathTrie(rules))

    def verdicts(batches):
        for batch in batches:
            found = [trie.value.find(h, p) for h, p in zip(batch["host"].to_pylist(), batch["path"].to_pylist(), strict=True)]
            rule = pa.array([f and f[0] for f in found], pa.string())
            verdict = pa.array([f[1] if f else default for f in found], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    kind = parsed.schema[key].dataType.simpleString()
    return parsed.transform(batches.bounded).mapInArrow(verdicts, f"`{key}` {kind}, host string, path string, rule string, verdict string")


def _by_join(parsed: DataFrame, rules, key: str, default: str) -> DataFrame:
    """The same verdicts for rule lists that are too large to broadcast."""
    rows = []
    for rule, verdict in distinct_rules(rules).items():
        host, slash, rest = rule.partition("/")
        head, _, last = (slash + rest).rpartition("/")
        rows.append((host, head, (slash + rest).count("/"), last, rule, verdict, len(rule), len(host)))
    known = parsed.sparkSession.createDataFrame(rows, "r_host string, r_head string, r_depth int, r_last string, rule string, r_verdict string, r_len int, r_host_len int")
    labels, pieces = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.struct(F.array_join(F.slice(pieces, 1, i - 1), "/").alias("head"), (i - 1).alias("depth"), F.element_at(pieces, i).alias("piece")))
    lengths = F.array(*[F.lit(n) for n in sorted({len(r[3]) for r in rows})])
    ends = F.transform(F.filter(lengths, lambda n: n <= F.length("h.piece")), lambda n: F.left(F.col("h.piece"), n))
    spread = parsed.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"), heads.alias("heads"))
    spread = spread.select("host", "path", "suffix", F.explode("heads").alias("h")).select("host", "path", "suffix", "h", F.explode(ends).alias("end"))
    met = spread.join(known, (F.col("suffix") == F.col("r_host")) & (F.col("h.head") == F.col("r_head")) & (F.col("h.depth") == F.col("r_depth")) & (F.col("end") == F.col("r_last")))
    best = met.groupBy(F.col("host").alias("b_host"), F.col("path").alias("b_path")).agg(F.max(F.struct("r_len", "r_host_len", "rule", "r_verdict")).alias("best"))
    joined = parsed.join(best, (F.col("host") == F.col("b_host")) & (F.col("path") == F.col("b_path")), "left")
    return joined.select(key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.r_verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, rule, r_host, r_path) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM parsed JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parsed p LEFT JOIN best b USING (page_id)
"""
