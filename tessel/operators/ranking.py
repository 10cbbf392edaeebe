"""Scores: parsing with one repair, ranking, term counts, budgeted and diversity-aware selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.functions import scalars as S

SCORE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("visual_interest", "energy", "usefulness", "redundancy")] + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("subjects", "actions")] + [T.StructField("_bad", T.StringType())])
NUMBERS = ("visual_interest", "energy", "usefulness", "redundancy")
REDUNDANT, SHAKY_INTEREST = 0.6, 0.5


def parse_score(content: Column) -> Column:
    """A score of four numbers from 0 to 1 from a model's answer; null where it isn't one. Missing numbers are 0."""
    got = F.from_json(S.json_object(S.strip_reasoning(content)), SCORE, {"columnNameOfCorruptRecord": "_bad"})
    numbers = [F.coalesce(got[n], F.lit(0.0)) for n in NUMBERS]
    ok = (S.json_object(S.strip_reasoning(content)) != "") & got["_bad"].isNull()
    for x in numbers:
        ok = ok & x.between(0.0, 1.0)
    return F.when(ok, F.struct(*[x.alias(n) for x, n in zip(numbers, NUMBERS, strict=True)], got["subjects"].alias("subjects"), got["actions"].alias("actions")))


def score_with_repair(responses: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, score, repaired) from (keys, attempt, content, reasoning): the first valid answer of two attempts; blank
    content falls back to the reasoning. score is null where neither is valid."""
    content = F.when(F.btrim("content") == "", F.col("reasoning")).otherwise(F.col("content"))
    own = responses.withColumn("parsed", parse_score(content))
    pick = lambda n: F.max_by("parsed", F.when(F.col("attempt") == n, F.lit(1)))
    both = own.groupBy(*keys).agg(pick(1).alias("first"), pick(2).alias("second"))
    return both.select(*keys, F.coalesce("first", "second").alias("score"), (F.col("first").isNull() & F.col("second").isNotNull()).alias("repaired"))


def divert_unscored(scored: DataFrame, group: list[str]) -> DataFrame:
    """``scored`` (group, score, ...) with ``reason``: "unscorable response" without a score, null with one. A group of
    which no row has a score is an error, as its model is broken."""
    some = scored.groupBy(*group).agg(F.count("score").alias("d_scored"), F.count("*").alias("d_rows"))
    told = F.format_string("every candidate segment failed scoring (%d of %d)", "d_rows", "d_rows")
    reason = F.when(F.col("d_scored") == 0, F.raise_error(told)).when(F.col("score").isNull(), "unscorable response")
    return scored.join(some, group).withColumn("reason", reason.cast("string")).drop("d_scored", "d_rows")


def shaky_split(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: shaky ones need enough interest."""
    return rows.withColumn("kept", ~(F.col("shaky") & (F.col("visual_interest") < SHAKY_INTEREST)))


def term_counts(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """(group, term, n, rank): in how many rows a term occurs; blank terms don't count."""
    terms = F.array_distinct(F.transform(column, S.term))
    counted = rows.select(*group, F.explode(terms).alias("term")).filter("term <> ''").groupBy(*group, "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*group).orderBy(F.desc("n"), "term") if group else Window.orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(order).cast("bigint"))


def select_prefix(rows: DataFrame, group: list[str], target: Column) -> DataFrame:
    """``rows`` (base, ord, seconds) with ``chosen``: taken in score order while what was taken before is under the target."""
    order = Window.partitionBy(*group).orderBy(F.desc("base"), "ord")
    before = F.coalesce(F.sum("seconds").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("chosen", before < target)


def select_diverse(rows: DataFrame, group: list[str], target: float) -> DataFrame:
    """``rows`` (base, ord, seconds, redundancy, subjects, actions) with ``chosen``, by the greedy fold.

    A row is dropped where the budget is reached, or where it repeats a chosen one: it shares a subject, adds no action,
    and one of the two is redundant. Each group is folded inside the JVM; a group must fit one task, as every decision
    needs the ones before it.
    """
    item = F.struct((-F.col("base")).alias("rank"), "ord", "seconds", "redundancy", F.transform("subjects", S.term).alias("subjects"), F.transform("actions", S.term).alias("actions"))
    queue = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("queue"))
    kind = "array<struct<rank:double,ord:bigint,seconds:double,redundancy:double,subjects:array<string>,actions:array<string>>>"
    start = F.struct(F.lit(0.0).alias("total"), F.array().cast(kind).alias("chosen"))

    def repeats(x: Column, other: Column) -> Column:
        flagged = (x["redundancy"] >= REDUNDANT) | (other["redundancy"] >= REDUNDANT)
        shared = F.coalesce(F.arrays_overlap(x["subjects"], other["subjects"]), F.lit(False))
        return flagged & shared & (F.size(F.array_except(x["actions"], other["actions"])) == 0)

    def step(state: Column, x: Column) -> Column:
        skip = (state["total"] >= target) | F.exists(state["chosen"], lambda other: repeats(x, other))
        return F.struct(F.when(skip, state["total"]).otherwise(state["total"] + x["seconds"]).alias("total"), F.when(skip, state["chosen"]).otherwise(F.concat(state["chosen"], F.array(x))).alias("chosen"))

    folded = queue.select(*group, F.aggregate("queue", start, step).alias("state"))
    chosen = folded.select(*group, F.explode("state.chosen.ord").alias("ord")).withColumn("chosen", F.lit(True))
    return rows.join(chosen, [*group, "ord"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(False)))


def energy_arc(rows: DataFrame, group: list[str]) -> DataFrame:
    order = Window.partitionBy(*group).orderBy("energy", F.desc("base"), "ord")
    return rows.withColumn("place", (F.row_number().over(order) - 1).cast("bigint"))
