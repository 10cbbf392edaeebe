"""Options, required fields, prompts and small ordered choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import scalars as S

# Allowed names, the default first.
PROFILES = ("balanced", "strict", "lenient")
SHAKE = ("reject", "stabilize")
DUCK = ("balanced", "subtle", "strong")
# The fields that a settings row must have, in the order of their report.
TEXT_FIELDS = ("container", "video_codec", "audio_codec", "pixel_format", "audio_channel_layout")
NUMBER_FIELDS = ("video_width", "video_height", "video_frame_rate", "audio_sample_rate", "audio_channels")


def choice(value: Column, allowed: tuple[str, ...]) -> Column:
    """An allowed name, the default where none is given, null for any other."""
    return F.when(F.coalesce(value, F.lit("")) == "", allowed[0]).when(value.isin(*allowed), value)


def precedence(*values: Column) -> Column:
    """The first of several text values, trimmed, that is neither null nor blank; null if all are."""
    return F.coalesce(*[F.nullif(F.btrim(v), F.lit("")) for v in values])


def search_path(folders: Column) -> Column:
    """An array of folders without empty ones and later repeats, in order."""
    return F.array_distinct(F.filter(folders, lambda f: F.coalesce(f, F.lit("")) != ""))


def relative_path(folder: Column, target: Column) -> Column:
    """``target`` as seen from ``folder``, both absolute or both relative; else the target itself. Empty parts and single
    dots don't count; parts named ``..`` are taken as they are."""
    parts = lambda c: F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    a, b = parts(folder), parts(target)
    same = F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda i: F.coalesce(F.get(a, i - 1) == F.get(b, i - 1), F.lit(False)))
    common = F.coalesce(F.nullif(F.array_position(same, F.lit(False)), F.lit(0)) - 1, F.size(same)).cast("int")
    up = F.concat(F.array_repeat(F.lit(".."), F.size(a) - common), F.slice(b, common + 1, F.size(b)))
    path = F.when(F.size(up) == 0, ".").otherwise(F.array_join(up, "/"))
    return F.when(folder.startswith("/") == target.startswith("/"), path).otherwise(target)


def duck_parameters(profile: Column) -> tuple[Column, Column]:
    """(threshold, ratio) of a ducking profile."""
    pick = lambda *x: F.when(profile == "subtle", x[0]).when(profile == "strong", x[1]).when(profile.isNotNull(), x[2])
    return pick(0.2, 0.05, 0.1), pick(2.0, 8.0, 4.0)


def missing_fields() -> Column:
    """Names of the required fields of a settings row that are blank or not positive."""
    text = [F.when(F.coalesce(F.col(n), F.lit("")) == "", F.lit(n)) for n in TEXT_FIELDS]
    number = [F.when(F.coalesce(F.col(n), F.lit(0)) <= 0, F.lit(n)) for n in NUMBER_FIELDS]
    return F.array_compact(F.array(*text, *number))


def first_known(value: Column, order: Column, default: str = "unknown") -> Column:
    """An aggregate: the first value, in order, that is not blank."""
    known = F.btrim(value) != ""
    return F.coalesce(F.min_by(F.when(known, value), F.when(known, order)), F.lit(default))


def preferred_first(rows: DataFrame, group: list[str], name: str, preferred: str, ties: list[str]) -> DataFrame:
    """One row a group: the preferred name if it is there, else the first by name."""
    order = Window.partitionBy(*group).orderBy((F.col(name) == preferred).desc(), name, *ties)
    return rows.withColumn("p_rank", F.row_number().over(order)).filter("p_rank = 1").drop("p_rank")


def candidate_prompt(source: Column, start: Column, stop: Column, times: Column, theme: Column, guidance: Column) -> Column:
    """The request that describes one candidate and the times of its sheet."""
    two = lambda x: F.format_string("%.2fs", x)
    told = lambda c, text: F.when(F.btrim(c) != "", text).otherwise("")
    return F.concat(
        F.lit("Source clip: "), source, F.lit("\nSegment: "), two(start), F.lit(" to "), two(stop),
        F.lit(".\nContact sheet tiles (left to right, top to bottom) were sampled at source times "), F.array_join(F.transform(times, two), ", "), F.lit(".\nScore this segment."),
        told(theme, "\nRemember the montage theme when scoring."), told(guidance, "\nRemember the user's selection guidance when scoring."),
    )


def parse_theme(content: Column) -> Column:
    """The theme of an answer, trimmed; null where there is none."""
    theme = F.btrim(F.from_json(S.json_object(S.strip_reasoning(content)), "theme string")["theme"])
    return F.when(theme != "", theme)
