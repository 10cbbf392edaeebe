"""Cue grids: cleaning, phrase and section marks, as-of lookup with tolerance, snapping along a moving timeline."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import repeat
from math import floor, isfinite

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

EPSILON, TOLERANCE, SNAPPED_MIN, MAJOR_GAP = 0.01, 0.5, 1.0, 0.25
PHRASE, SECTION = 8, 32
PRIORITY = ("section", "phrase", "beat")


def first_fields(text: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t) from (keys, raw): the first field of each line that is a number."""
    lines = text.select(*keys, F.explode(F.split("raw", "\n")).alias("line"))
    return lines.withColumn("t", F.split(F.btrim("line"), r"\s+")[0].try_cast("double")).filter("t IS NOT NULL").drop("line")


def clean(times: Column, duration: Column) -> Column:
    """Ascending times within [0, duration + 0.01], each at least 0.01 after the last one kept."""
    inside = F.array_sort(F.filter(times, lambda x: (x >= 0) & (x <= duration + EPSILON)))
    return F.aggregate(inside, F.array().cast("array<double>"), lambda kept, x: F.when((F.size(kept) > 0) & (x - F.element_at(kept, -1) < EPSILON), kept).otherwise(F.concat(kept, F.array(x))))


def marks(beats: DataFrame, group: list[str]) -> DataFrame:
    """(group, t) -> + n, and whether the beat opens a phrase or a section."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy("t")) - 1
    return beats.withColumn("n", n.cast("bigint")).withColumn("phrase", F.col("n") % PHRASE == 0).withColumn("section", F.col("n") % SECTION == 0)


def prior_cue(boundaries: DataFrame, cues: DataFrame, group: list[str]) -> DataFrame:
    """``boundaries`` (group, id, boundary, major) with the cue each one reaches: the latest at most 0.01 after and 0.5
    before it, of the best kind that has one; a minor change looks at beats alone.

    Both sides meet by equality on half-second buckets: one for each cue, and for each boundary all that its reach touches,
    two or, near the edge of a bucket, three. The lower end has the same slack as the upper, so rounding loses no cue.
    """
    bucket = lambda x: F.floor(x / TOLERANCE)
    spread = boundaries.withColumn("b", F.explode(F.sequence(bucket(F.col("boundary") - TOLERANCE - EPSILON), bucket(F.col("boundary") + EPSILON))))
    timed = cues.select(*group, "kind", F.col("t").alias("cue"), bucket(F.col("t")).alias("b"))
    fits = (F.col("cue") <= F.col("boundary") + EPSILON) & (F.col("boundary") - F.col("cue") <= TOLERANCE) & (F.col("major") | (F.col("kind") == "beat"))
    order = F.struct((-F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("kind"))).alias("p"), "cue", "kind")
    best = spread.join(timed, [*group, "b"]).filter(fits).groupBy(*group, "id").agg(F.max(order).alias("best"))
    return boundaries.join(best, [*group, "id"], "left").withColumns({"cue": F.col("best.cue"), "kind": F.col("best.kind")}).drop("best")


def snap(segments: DataFrame, cues: DataFrame | float, group: list[str]) -> DataFrame:
    """(group, ord, source, start, stop, base) with ``snapped`` and ``cue``: cut after cut is moved to a prior cue.

    ``cues`` are arrays by kind, one row a group, or the seconds between beats of a grid without end. A null time ends the
    snapping of its group.

    Each boundary depends on how earlier ones were moved, so a group is folded in order. Its rows stream through the fold as
    the window hands them on, after a row with the cues if there are arrays: no group is collected or joined back, and
    segments that a window over the group has dealt before are not shuffled again.
    """
    known = lambda df, *names: df.filter(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
    rows = known(segments, *group, "ord")
    if isinstance(cues, DataFrame):
        lists = F.struct(*[F.array_sort(F.array_compact(F.coalesce(f"{c}s", F.array()))).alias(c) for c in PRIORITY])
        rows = rows.unionByName(known(cues, *group).select(*group, lists.alias("_cues")), allowMissingColumns=True)
    order = Window.partitionBy(*group).orderBy(F.col("ord").asc_nulls_first())
    ahead = lambda c: F.lead(c).over(order)
    major = (F.col("source") != ahead("source")) | (F.abs(F.col("base") - ahead("base")) >= MAJOR_GAP)
    rows = rows.withColumns({"_opens": F.row_number().over(order) == 1, "_major": F.when(ahead("ord").isNotNull(), F.coalesce(major, F.lit(False)))})
    names, beat = segments.columns, None if isinstance(cues, DataFrame) else float(cues)

    def run(batches):
        line, latest = 0.0, _in_grid(beat)
        for batch in batches:
            if beat is None:
                given = batch.column("_cues")
                lists, own = given.to_pylist(), pc.is_null(given)
            else:
                lists, own = repeat(None, batch.num_rows), None
            ends, kinds = [], []
            for opens, turn, a, b, times in zip(*[batch.column(c).to_pylist() for c in ("_opens", "_major", "start", "stop")], lists, strict=True):
                if opens:
                    line = 0.0
                    if beat is None:
                        latest = _in_lists(times)
                line, end, kind = move_cut(line, a, b, turn, latest)
                ends.append(end)
                kinds.append(kind)
                if times is not None:
                    line = 0.0
            moved = pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(ends, pa.float64()), pa.array(kinds, pa.string())], names=[*names, "snapped", "cue"])
            yield moved if own is None else moved.filter(own)

    return rows.mapInArrow(run, StructType([*segments.schema.fields, StructField("snapped", DoubleType()), StructField("cue", StringType())]))


def _in_grid(beat: float | None) -> Callable[[str, float], float | None]:
    """The latest cue of a kind up to a time, on the grid of beats with their phrases and sections."""
    steps = {} if beat is None else {"section": beat * SECTION, "phrase": beat * PHRASE, "beat": beat}

    def latest(kind, x):
        places = x / steps[kind]
        return steps[kind] * floor(places) if isfinite(places) else None

    return latest


def _in_lists(times: dict[str, list[float]] | None) -> Callable[[str, float], float | None]:
    """The same among ascending cues by kind, by bisection; None holds no cues."""

    def latest(kind, x):
        at = bisect_right(times[kind], x) if times else 0
        return times[kind][at - 1] if at else None

    return latest


def move_cut(line: float | None, start: float | None, stop: float | None, major: bool | None, latest: Callable) -> tuple[float | None, float | None, str]:
    """(timeline after it, end, kind of cue) of a segment that begins at ``line``; ``major`` is null for the last one."""
    if line is None or start is None or stop is None:
        return None, stop, ""
    seconds = stop - start
    boundary = line + seconds
    for kind in () if major is None else PRIORITY if major else PRIORITY[-1:]:
        cue = latest(kind, boundary + EPSILON)
        if cue is not None and boundary - cue <= TOLERANCE:
            if cue - line >= SNAPPED_MIN:
                seconds = cue - line
                return line + seconds, start + seconds, kind
            break
    return line + seconds, stop, ""


def music_cues(tracks: DataFrame, text: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, requested, duration, beats, onsets, phrases, sections, problem) of tracks (keys, requested, duration) and the
    generator's text (keys, kind in beat or onset, raw): parsed, cleaned, and with phrase and section marks. A track that
    is unreadable, or shorter than what is requested of it, has a problem."""
    parsed = first_fields(text, [*keys, "kind"]).groupBy(*keys).agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("t"))).alias(f"m_{k}") for k in ("beat", "onset")])
    got = tracks.join(parsed, keys, "left")
    none = F.array().cast("array<double>")
    got = got.withColumns({n: clean(F.coalesce(F.col(f"m_{k}"), none), F.col("duration")) for k, n in (("beat", "beats"), ("onset", "onsets"))})
    every = lambda n: F.filter("beats", lambda x, i: i % n == 0)
    problem = F.when(F.coalesce(F.col("duration") <= 0, F.lit(True)), "unreadable music track").when((F.col("requested") > 0) & (F.col("requested") > F.col("duration") + EPSILON), "requested duration is longer than the music track")
    return got.select(*keys, "requested", "duration", "beats", "onsets", every(PHRASE).alias("phrases"), every(SECTION).alias("sections"), problem.alias("problem"))
