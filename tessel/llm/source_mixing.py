"""Mixing sources to target weights: hash-random keys, range-sort within each source, distributed prefix sums, exact cuts.

Every document has a size, its number of words. Sources get weights in rotation by the order of their names; together
they may take ``share`` of all words, but no source more than ``cap`` times its own words: what a source cannot take is
shared again among the others by weight (water filling). Within a source, documents are ordered by a hash-random key;
whole epochs take every document, and the last one is cut at the exact remaining budget, inside a document if need be.

How it scales: a key's leading digits are its range, so ranges split even a source that holds a third of all rows.
Running sums are made within (source, range) and carried over by a prefix sum over the small table of range totals, 4,096
rows a source at most. Nothing is sampled, and reruns agree because keys depend on the document id alone, or on the text where that is null.

Defined cases: a null or blank text has size 0 and takes nothing; null sources form one source that comes last; a source
without words has target 0; ids that repeat share a key and are ordered by size, equal rows in any order (they are
interchangeable); an empty table gives an empty result; extra columns of any name do no harm, as rows are carried in one
struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.sources.tables import table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
#: Hexadecimal digits of the key that name its range: 16 ** 3 ranges a source.
RANGE_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> + weight, target. One row a source; the windows here see that small table alone."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = totals.withColumn("weight", weight).withColumn("limit", (F.col("source_size") * cap).cast("double"))
    # Sources fill up in the order of limit / weight. With the first j full, the others get level j times their weight.
    filling = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before, all_rows = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    spare = F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = weighed.withColumn("level", left / spare)
    fits = F.when(F.col("limit") >= F.col("level") * F.col("weight"), F.struct(F.row_number().over(filling).alias("n"), F.col("level").alias("level")))
    settled = levels.withColumn("first", fits).withColumn("final", F.min("first").over(all_rows)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("final") * F.col("weight"), F.col("limit")))
    return settled.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, key: str = "doc_id", text: str = "text", source: str = "source", carry: bool = False) -> DataFrame:
    """(id, source, size, source_size, target, taken) of every document; with ``carry`` also ``row``, the input row."""
    # Rows without an id get keys by their texts, so that many of them don't fall into one range.
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("null "), F.md5(F.col(text))), F.lit("null")))
    kept = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    sized = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), word_count(text).alias("size"), digest.alias("key"), *kept)
    sized = sized.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    by_range = Window.partitionBy("source", "range")
    ordered = by_range.orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = sized.withColumn("upto", F.sum("size").over(ordered))
    # The totals come from the same exchange as the running sums where no rows are carried.
    totals = (sized if carry else running).groupBy("source", "range").agg((F.sum("size") if carry else F.max("upto")).alias("range_size"))
    prefix = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = totals.withColumn("before_range", F.coalesce(F.sum("range_size").over(prefix), F.lit(0)))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, share, cap)
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    cuts = ranges.alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
    cuts = cuts.select(F.col("r.source").alias("c_source"), F.col("r.range").alias("c_range"), "before_range", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    joined = running.join(cuts, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("range") == F.col("c_range")))
    start = F.col("before_range") + F.col("upto") - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start)).cast("long")
    carried = ["row", "epochs", last.alias("last")] if carry else []
    return joined.select("id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + last).alias("taken"), *carried)


def materialise(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``.

    A document comes once for each whole epoch and once more where the last, partial epoch takes it; the one at which a
    source's budget ends is cut after the last word that the budget still covers.
    """
    text = options.get("text", "text")
    mixed = mix(docs, carry=True, **options)
    copies = F.concat(F.array_repeat(F.col("size"), F.col("epochs").cast("int")), F.when(F.col("last") > 0, F.array("last")).otherwise(F.array().cast("array<bigint>")))
    spread = mixed.select("row", "size", F.explode(copies).alias("words")).filter(F.col("words") > 0)
    pieces = F.regexp_extract_all(F.col("row")[text], F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    head = F.array_join(F.slice(pieces, F.lit(1), F.col("words").cast("int")), "")
    cut = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("row")[text])
    return spread.select(*[(cut if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source
), w AS (
  SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, (2 * source_size)::DOUBLE AS lim FROM s
), f AS (
  SELECT *, row_number() OVER o AS k,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM w WINDOW o AS (ORDER BY lim / weight, source NULLS LAST)
), t AS (
  SELECT *, least(lim, coalesce((SELECT arg_min(level, k) FROM f WHERE lim >= level * weight) * weight, lim)) AS target FROM f
), e AS (
  SELECT source, source_size, target, floor(target)::BIGINT AS budget, CASE WHEN source_size > 0 THEN (floor(target)::BIGINT // source_size)::BIGINT ELSE 0 END AS epochs FROM t
), r AS (
  SELECT doc_id, size, source_size, target, epochs, budget - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM r
"""
