"""Scalar functions as Column expressions, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants that define the semantics.
MIN_SEGMENT, TARGET_MIN, TARGET_MAX = 1.0, 3.0, 8.0
STATIC_MOTION, AUDIO_FLOOR = 2.0, -120.0
FADE_MIN, FADE_MAX, FADE_DEFAULT, FADE_SHARE = 0.15, 0.8, 0.4, 0.2
EPSILON = 1e-6


def key_float(line: Column) -> Column:
    """The number after the first ``=``; 0 where there is none."""
    value = F.regexp_extract(line, r"^[^=]*=\s*(.*?)\s*$", 1)
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def named_float(line: Column, name: str) -> Column:
    """The number of the field ``name:number``; 0 where there is none."""
    return F.coalesce(F.regexp_extract(line, rf"(?:^|\s){name}:(\S+)", 1).try_cast("double"), F.lit(0.0))


def strip_reasoning(raw: Column) -> Column:
    """Text without reasoning tags; a tag that is never closed takes the rest with it."""
    return F.btrim(F.regexp_replace(F.regexp_replace(raw, r"(?s)<think>.*?</think>", ""), r"(?s)<think>.*", ""))


def json_object(raw: Column) -> Column:
    """From the first opening brace to the last closing one; empty without both."""
    return F.regexp_extract(raw, r"(?s)\{.*\}", 0)


def term(text: Column) -> Column:
    """A term without outer white space, in lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""))


def escape_filter(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\:' ])", r"\\$1")


def fixed_seconds(x: Column) -> Column:
    return F.format_string("%.6f", x)


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, r"^\s*([^\n]*?)\s*(?:\n|$)", 1)


def kbps(text: Column) -> Column:
    """The leading integer of a rate such as 2800k; 0 without one."""
    return F.coalesce(F.regexp_extract(text, r"^(\d+)", 1).try_cast("int"), F.lit(0))


def base_score(interest: Column, usefulness: Column, energy: Column) -> Column:
    return 0.5 * interest + 0.3 * usefulness + 0.2 * energy


def target_duration(eligible: Column, override: Column) -> Column:
    """An override as it is, else 15 % within 30 and 120 seconds, never more than there is."""
    return F.when(override > 0, override).otherwise(F.least(F.greatest(0.15 * eligible, F.lit(30.0)), F.lit(120.0), eligible))


def bound_transition(requested: Column, before: Column, own: Column) -> Column:
    """Within the band and a fifth of each neighbour, of which the first may be absent (0); the floor comes last."""
    capped = F.least(requested, F.lit(FADE_MAX), FADE_SHARE * own, F.when(before > 0, FADE_SHARE * before).otherwise(F.lit(FADE_MAX)))
    return F.greatest(capped, F.lit(FADE_MIN))


def can_host(before: Column, own: Column) -> Column:
    """Whether both neighbours are long enough for the shortest transition."""
    fits = lambda x: FADE_SHARE * x >= FADE_MIN - EPSILON
    return fits(own) & ((before <= 0) | fits(before))


def round_ms(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def hardware_kbps(width: Column, height: Column, rate: Column) -> Column:
    return F.greatest(F.round(width.cast("double") * height * rate * 0.10 / 1000), F.lit(2000)).cast("int")


def display_size(width: Column, height: Column, rotation: Column) -> tuple[Column, Column]:
    """Width and height as shown: a quarter turn swaps them."""
    turned = F.pmod(rotation, F.lit(360)).isin(90, 270)
    return F.when(turned, height).otherwise(width), F.when(turned, width).otherwise(height)


def rotation(side: Column, tag: Column) -> Column:
    """Any side entry wins, even one of 0; else the tag, else 0."""
    return F.when(F.coalesce(F.size(side), F.lit(0)) > 0, F.coalesce(F.get(side, F.lit(0))["rotation"], F.lit(0))).otherwise(F.coalesce(tag.try_cast("int"), F.lit(0)))


def memo_key(category: Column, mark: Column, settings: Column) -> Column:
    """category-sha256 over category, fingerprint and the settings of a map in the order of name=value."""
    pairs = F.array_sort(F.transform(F.map_entries(settings), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return F.concat(category, F.lit("-"), F.sha2(F.concat_ws("\x1f", category, mark, F.array_join(pairs, "\x1f")), 256))


def fingerprint(content: Column, sample: int = 4 << 20) -> Column:
    """v1:size:sha256 of the head and, beyond ``sample`` bytes, the tail as well."""
    size = F.octet_length(content)
    ends = F.when(size > sample, F.concat(F.substring(content, 1, sample), F.substring(content, -sample, sample))).otherwise(content)
    return F.concat(F.lit("v1:"), size.cast("string"), F.lit(":"), F.sha2(ends, 256))


def shares_term(left: Column, right: Column) -> Column:
    return F.coalesce(F.arrays_overlap(F.transform(left, term), F.transform(right, term)), F.lit(False))


def has_other_term(left: Column, right: Column) -> Column:
    """Whether ``left`` has a term that ``right`` lacks."""
    return F.size(F.array_except(F.transform(left, term), F.transform(right, term))) > 0
