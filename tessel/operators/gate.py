"""Measurements of intervals, threshold profiles and the gate that records every reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import scalars as S

# Blur, luma from, luma to, motion, level.
PROFILES = [("strict", 10.0, 35.0, 220.0, 18.0, -45.0), ("lenient", 22.0, 16.0, 240.0, 35.0, -55.0), ("balanced", 15.0, 25.0, 230.0, 25.0, -50.0)]
# The gate's reasons, hard ones first.
REASONS = ("shorter than one second", "excessive blur", "severely underexposed", "severely overexposed", "excessive camera shake")


def profiles(spark: SparkSession) -> DataFrame:
    """The three threshold rows; always small enough to broadcast."""
    return F.broadcast(spark.createDataFrame(PROFILES, "profile string, max_blur double, min_luma double, max_luma double, max_motion double, min_rms double"))


def metric_lines(text: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, name, x) from (keys, raw), the text of the measuring filters: blur, YAVG, YMIN, YMAX, RMS_level, Peak_level,
    silence_start. A value that is no number counts as 0; infinities are kept."""
    line = F.btrim("line", F.lit(" \t\r"))
    name = (
        F.when(line.startswith("lavfi.blur="), "blur")
        .when(line.rlike(r"^lavfi\.signalstats\.Y(AVG|MIN|MAX)="), F.regexp_extract(line, r"^lavfi\.signalstats\.(Y\w+)=", 1))
        .when(line.contains(".RMS_level="), "RMS_level")
        .when(line.contains(".Peak_level="), "Peak_level")
        .when(line.startswith("lavfi.silence_start"), "silence_start")
    )
    value = F.lower(F.btrim(F.regexp_extract(line, r"=(.*)$", 1)))
    number = F.when(value.isin("-inf", "-infinity"), F.lit(float("-inf"))).when(value.isin("inf", "+inf", "infinity"), F.lit(float("inf"))).otherwise(F.coalesce(value.try_cast("double"), F.lit(0.0)))
    return text.select(*keys, F.explode(F.split("raw", "\n")).alias("line")).select(*keys, name.alias("name"), number.alias("x")).filter("name IS NOT NULL")


def video_metrics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean blur, mean luma, least and greatest luma from (keys, name, x); 0 where a name is absent."""
    own = lambda agg, name: F.coalesce(agg(F.when(F.col("name") == name, F.col("x"))), F.lit(0.0))
    return lines.groupBy(*keys).agg(own(F.avg, "blur").alias("blur"), own(F.avg, "YAVG").alias("luma"), own(F.min, "YMIN").alias("luma_min"), own(F.max, "YMAX").alias("luma_max"))


def audio_metrics(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Mean finite level, greatest finite peak, and silence: a marker, or nothing seen. Only infinities are left out."""
    finite = F.abs("x") != float("inf")
    level, peak = F.when((F.col("name") == "RMS_level") & finite, F.col("x")), F.when((F.col("name") == "Peak_level") & finite, F.col("x"))
    marked = F.bool_or(F.col("name") == "silence_start")
    floor = F.lit(S.AUDIO_FLOOR)
    return lines.groupBy(*keys).agg(
        F.coalesce(F.avg(level), floor).alias("rms"), F.greatest(F.coalesce(F.max(peak), floor), floor).alias("peak"), (marked | (F.count(level) + F.count(peak) == 0)).alias("silent")
    )


def gate(rows: DataFrame, thresholds: DataFrame, stabilise: bool = False) -> DataFrame:
    """``rows`` (profile, seconds, blur, luma, motion, ...) with reasons, hard, shaky, needs_stabilisation, eligible.

    NaN measurements must be rejected before, as comparisons with NaN differ between engines.
    """
    r = rows.join(thresholds, "profile")
    failed = [F.col("seconds") < S.MIN_SEGMENT, F.col("blur") > F.col("max_blur"), F.col("luma") < F.col("min_luma"), F.col("luma") > F.col("max_luma")]
    shaky = F.col("motion") > F.col("max_motion")
    noted = [*failed, shaky & F.lit(not stabilise)]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(text)) for c, text in zip(noted, REASONS, strict=True)]))
    hard = failed[0] | failed[1] | failed[2] | failed[3]
    return r.withColumns({"reasons": reasons, "hard": hard, "shaky": shaky, "needs_stabilisation": shaky & F.lit(stabilise), "eligible": ~hard & (~shaky | F.lit(stabilise))}).drop("max_blur", "min_luma", "max_luma", "max_motion")


def audio_usable(rows: DataFrame) -> DataFrame:
    return rows.withColumn("audio_usable", ~F.col("silent") & (F.col("rms") >= F.col("min_rms")))


def eligible_ordinals(gated: DataFrame, order: list[str], within: list[str]) -> DataFrame:
    """Eligible rows with their ordinal ``ord`` among the eligible ones of each group."""
    return gated.filter("eligible").withColumn("ord", (F.row_number().over(Window.partitionBy(*within).orderBy(*order)) - 1).cast("bigint"))


def majority(rows: DataFrame, group: list[str], choice: str, weight: str) -> DataFrame:
    """The choice of greater summed weight in each group, null at a tie."""
    sums = rows.groupBy(*group, choice).agg(F.sum(weight).alias("total"))
    best = sums.groupBy(*group).agg(F.max("total").alias("total"), F.max_by(choice, "total").alias("winner"))
    ties = sums.withColumnRenamed("total", "own").join(best, group).filter(F.abs(F.col("own") - F.col("total")) < 1e-9).groupBy(*group, "total", "winner").agg(F.count("*").alias("n"))
    return ties.select(*group, F.when(F.col("n") == 1, F.col("winner")).alias("winner"), "total")
