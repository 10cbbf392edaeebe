"""The driver tables seen as clips, frames, intervals and segments, in Spark and in SQL.

A clip is a user, its length the hours from the user's first event to the last; an event is a frame at its hour, its
value the signal, and an error is a cut. Orders are measured intervals, their lines the measurements.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators import intervals
from tessel.sources.tables import table


def frames(spark, sf):
    e = table(spark, sf, "events")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    first = F.min(at).over(Window.partitionBy("user_id"))
    return e.select(F.col("user_id").alias("clip"), "event_id", ((at - first) / F.lit(3600000000.0)).alias("t"), F.col("value").alias("mafd"), (F.col("event_type") == "error").alias("cut"), "event_type")


def clips(spark, sf):
    return frames(spark, sf).groupBy("clip").agg(F.max("t").alias("duration"))


def shot_rows(spark, sf):
    f, c = frames(spark, sf), clips(spark, sf)
    return intervals.shots(intervals.interior_cuts(f, c), c)


def candidate_rows(spark, sf):
    return intervals.candidates(shot_rows(spark, sf), clips(spark, sf), frames(spark, sf))


def ranked(spark, sf):
    """Lines of orders as scored candidates; the clip is the customer, and ``ord`` their order within it.

    Rows are dealt by the column that later windows name, so that these need no other shuffle, and before the values that
    follow from the lines are added.
    """
    l, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("clip"))
    w = Window.partitionBy("clip").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("ord", (F.row_number().over(w) - 1).cast("bigint"))
    interest, energy, usefulness = F.col("l_discount") * 10, F.col("l_quantity") / 50, F.col("l_tax") * 10
    start = F.col("l_linenumber") * 100.0
    return rows.select(
        "clip", "ord", F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("part"),
        F.col("l_orderkey").alias("orderkey"), start.alias("start"), (start + F.col("l_quantity") / 4).alias("stop"), (F.col("l_quantity") / 4).alias("seconds"),
        F.round(0.5 * interest + 0.3 * usefulness + 0.2 * energy, 6).alias("base"), energy.alias("energy"), interest.alias("visual_interest"),
        (F.col("l_partkey") % 10 / 10.0).alias("redundancy"), (F.col("l_returnflag") == "R").alias("shaky"),
        F.element_at(F.array(*map(F.lit, ("", "beat", "phrase", "section"))), (F.col("l_partkey") % 4 + 1).cast("int")).alias("cue"),
    )


def planned(spark, sf):
    """All ranked candidates of each clip as segments with transitions."""
    from tessel.operators import segments

    return segments.plan_transitions(ranked(spark, sf), ["clip"], "ord")


# The same views in DuckDB's SQL, as common table expressions.
FRAMES = """ev AS (SELECT user_id AS clip, event_id, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 3600000000.0::DOUBLE AS t, value AS mafd, event_type = 'error' AS cut, event_type FROM events),
clip AS (SELECT clip, max(t) AS duration FROM ev GROUP BY clip)"""
CUTS = FRAMES + """,
cuts AS (SELECT ev.clip, t FROM ev JOIN clip USING (clip) WHERE cut AND t > 1 AND t < duration - 1)"""
SHOTS = CUTS + """,
bounds AS (SELECT clip, 0.0::DOUBLE AS t, 0 AS side FROM clip UNION ALL SELECT clip, duration, 2 FROM clip UNION ALL SELECT clip, t, 1 FROM cuts),
shots AS (SELECT clip, shot, start, stop FROM (SELECT clip, row_number() OVER w - 1 AS shot, t AS start, lead(t) OVER w AS stop FROM bounds WINDOW w AS (PARTITION BY clip ORDER BY t, side)) WHERE stop IS NOT NULL)"""
CANDIDATES = SHOTS + """,
moving AS (SELECT s.clip, s.shot, s.start, s.stop, duration, s.stop - s.start AS d, coalesce(avg(e.mafd), 0) AS motion
  FROM shots s JOIN clip USING (clip) LEFT JOIN ev e ON e.clip = s.clip AND e.t >= s.start AND e.t < s.stop GROUP BY ALL),
parts AS (SELECT *, ceil(d / 8.0)::BIGINT AS n FROM moving),
cand AS (
  SELECT clip, shot, 0::BIGINT AS part, start, stop FROM parts WHERE (d < 1 AND duration <= 3 AND d > 0) OR (d >= 1 AND d <= 8)
  UNION ALL SELECT clip, shot, 0, greatest(start, (start + stop) / 2 - 4.0), least(stop, greatest(start, (start + stop) / 2 - 4.0) + 8.0) FROM parts WHERE d > 8 AND motion < 2
  UNION ALL SELECT clip, shot, i, start + i * (d / n), CASE WHEN i = n - 1 THEN stop ELSE start + i * (d / n) + d / n END FROM (SELECT *, unnest(range(n)) AS i FROM parts WHERE d > 8 AND motion >= 2))"""
RANKED = """ranked AS (
  SELECT o_custkey AS clip, row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS ord, l_suppkey AS source, l_partkey AS part, l_orderkey AS orderkey,
    l_linenumber * 100.0::DOUBLE AS start, l_linenumber * 100.0::DOUBLE + l_quantity / 4 AS stop, l_quantity / 4 AS seconds,
    round(0.5::DOUBLE * (l_discount * 10) + 0.3::DOUBLE * (l_tax * 10) + 0.2::DOUBLE * (l_quantity / 50), 6) AS base, l_quantity / 50 AS energy, l_discount * 10 AS visual_interest,
    (l_partkey % 10) / 10.0::DOUBLE AS redundancy, l_returnflag = 'R' AS shaky, ['', 'beat', 'phrase', 'section'][l_partkey % 4 + 1] AS cue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
PLANNED = RANKED + """,
joined AS (SELECT *, stop - start AS own, coalesce(lag(stop - start) OVER w, 0) AS prev, lag(source) OVER w AS prev_source FROM ranked WINDOW w AS (PARTITION BY clip ORDER BY ord)),
named AS (SELECT *, 0.2::DOUBLE * own >= 0.15::DOUBLE - 1e-6 AND (prev <= 0 OR 0.2::DOUBLE * prev >= 0.15::DOUBLE - 1e-6) AS hosts FROM joined),
chosen AS (SELECT *, CASE WHEN ord = 0 THEN CASE WHEN hosts THEN 'fade' ELSE 'cut' END WHEN coalesce(source = prev_source, false) OR NOT hosts THEN 'cut' ELSE 'dissolve' END AS transition,
  CASE WHEN ord = 0 THEN 0.5::DOUBLE WHEN cue = 'section' THEN 0.15::DOUBLE WHEN cue = 'phrase' THEN 0.25::DOUBLE WHEN cue = 'beat' THEN 0.3::DOUBLE ELSE 0.4::DOUBLE END AS asked FROM named),
planned AS (SELECT * EXCLUDE (own, prev, prev_source, hosts, asked),
  CASE WHEN transition = 'cut' THEN 0.0::DOUBLE ELSE greatest(least(asked, 0.8::DOUBLE, 0.2::DOUBLE * own, CASE WHEN prev > 0 THEN 0.2::DOUBLE * prev ELSE 0.8::DOUBLE END), 0.15::DOUBLE) END AS transition_seconds,
  CASE WHEN transition = 'cut' THEN '' WHEN ord = 0 THEN 'opening fade in from black' WHEN cue = 'section' THEN 'shortened at a section Music Cue' WHEN cue = 'phrase' THEN 'shortened at a phrase Music Cue'
    WHEN cue = 'beat' THEN 'tightened to a beat Music Cue' ELSE 'cross-dissolve across a Source Clip change' END AS transition_reason FROM chosen)"""
