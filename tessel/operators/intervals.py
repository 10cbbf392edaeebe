"""Signals and intervals: parsing, cuts, shots, candidate windows, means of a signal over intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import scalars as S

#: Width of the time buckets of the range join.
BUCKET = 8.0


def parse_signal(text: DataFrame) -> DataFrame:
    """(clip, frame, t, mafd, cut) from (clip, raw): ``frame:`` opens a record, later key lines fill it, the last wins."""
    lines = text.select("clip", F.posexplode(F.split("raw", "\n")).alias("line", "content"))
    order = Window.partitionBy("clip").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("frame", F.sum(F.when(F.startswith("content", F.lit("frame:")), 1).otherwise(0)).over(order)).filter("frame > 0")
    c = F.col("content")
    t = F.max(F.when(c.startswith("frame:"), S.named_float(c, "pts_time")))
    mafd = F.max_by(F.when(c.contains(".mafd="), S.key_float(c)), F.when(c.contains(".mafd="), F.col("line")))
    cut = F.bool_or(c.contains("scd.time="))
    return numbered.groupBy("clip", "frame").agg(t.alias("t"), F.coalesce(mafd, F.lit(0.0)).alias("mafd"), cut.alias("cut"))


def interior_cuts(frames: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, t) of cuts more than a second away from both ends of their clip."""
    return frames.filter("cut").join(clips, "clip").filter((F.col("t") > 1) & (F.col("t") < F.col("duration") - 1)).select("clip", "t")


def shots(cuts: DataFrame, clips: DataFrame) -> DataFrame:
    """(clip, shot, start, stop) between consecutive bounds: 0, the cuts, the clip's end."""
    ends = clips.select("clip", F.explode(F.array(F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("side")), F.struct(F.col("duration").alias("t"), F.lit(2).alias("side")))).alias("b"))
    bounds = ends.select("clip", "b.t", "b.side").unionByName(cuts.select("clip", "t", F.lit(1).alias("side")))
    order = Window.partitionBy("clip").orderBy("t", "side")
    paired = bounds.withColumn("stop", F.lead("t").over(order)).withColumn("shot", (F.row_number().over(order) - 1).cast("bigint"))
    return paired.filter("stop IS NOT NULL").select("clip", "shot", F.col("t").alias("start"), "stop")


def mean_signal(intervals: DataFrame, frames: DataFrame, keys: list[str], bucket: float = BUCKET) -> DataFrame:
    """``intervals`` with ``motion``, the mean of mafd over frames in [start, stop), 0 without frames, and their number
    ``n_frames``.

    Frames and intervals meet by equality on (clip, time bucket), so that neither a long clip nor a hot one is one task's
    work. Partial sums come before the second grouping.
    """
    spread = intervals.withColumn("b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    timed = frames.select("clip", "t", "mafd", F.floor(F.col("t") / bucket).alias("b"))
    inside = spread.join(timed, ["clip", "b"]).filter((F.col("t") >= F.col("start")) & (F.col("t") < F.col("stop")))
    sums = inside.groupBy(*keys).agg(F.avg("mafd").alias("mean"), F.count("*").alias("found"))
    joined = intervals.join(sums, keys, "left")
    return joined.withColumns({"motion": F.coalesce("mean", F.lit(0.0)), "n_frames": F.coalesce("found", F.lit(0))}).drop("mean", "found")


def candidates(shot_rows: DataFrame, clips: DataFrame, frames: DataFrame) -> DataFrame:
    """(clip, shot, part, start, stop): short shots go unless the clip is short, long static ones shrink to a window in
    their middle, long moving ones are split evenly."""
    measured = mean_signal(shot_rows, frames, ["clip", "shot"]).join(clips, "clip")
    length, start, stop = F.col("stop") - F.col("start"), F.col("start"), F.col("stop")
    piece = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
    centre = F.greatest(start, (start + stop) / 2 - S.TARGET_MAX / 2)
    parts = F.ceil(length / S.TARGET_MAX)
    step = length / parts
    even = F.transform(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1), lambda i: piece(start + i * step, F.when(i == parts - 1, stop).otherwise(start + i * step + step)))
    windows = (
        F.when(length < S.MIN_SEGMENT, F.when((F.col("duration") <= S.TARGET_MIN) & (length > 0), F.array(piece(start, stop))))
        .when(length <= S.TARGET_MAX, F.array(piece(start, stop)))
        .when(F.col("motion") < S.STATIC_MOTION, F.array(piece(centre, F.least(stop, centre + S.TARGET_MAX))))
        .otherwise(even)
    )
    spread = measured.select("clip", "shot", F.posexplode(windows).alias("part", "w"))
    return spread.select("clip", "shot", F.col("part").cast("bigint").alias("part"), "w.start", "w.stop")


def sample_times(intervals: DataFrame, n: int = 4) -> DataFrame:
    """``intervals`` with n evenly spaced times from the start on."""
    step = (F.col("stop") - F.col("start")) / n
    return intervals.withColumn("times", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("start") + i * step))
