"""Chosen segments: trimming, transitions, dialogue continuity, timeline, fades, and the rules a plan must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions import scalars as S

WINDOW, MIN_SPEECH = 0.75, 0.2
# The approved joins.
OVERLAPPING = ("dissolve", "wipeleft", "wiperight", "wipeup", "wipedown", "slideleft", "slideright", "slideup", "slidedown")
DIPS = {"dip-black": "black", "dip-white": "white"}
APPROVED = ("cut", "fade", *OVERLAPPING, *DIPS)
# Length and reason of a transition at a cue of each kind.
AT_CUE = {"section": (0.15, "shortened at a section Music Cue"), "phrase": (0.25, "shortened at a phrase Music Cue"), "beat": (0.3, "tightened to a beat Music Cue")}


def trim_to_budget(rows: DataFrame, group: list[str], order: str, budget: Column, epsilon: float = 0.01) -> DataFrame:
    """Rows (start, stop) up to the budget: the one that crosses it is cut there, later ones go."""
    upto = Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    left = budget - F.coalesce(F.sum(F.col("stop") - F.col("start")).over(upto), F.lit(0.0))
    crosses = F.col("stop") - F.col("start") > F.col("left") + epsilon
    return rows.withColumn("left", left).filter(F.col("left") > epsilon).withColumn("trimmed", F.when(crosses, F.col("start") + F.col("left")).otherwise(F.col("stop"))).drop("left")


def plan_transitions(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``rows`` (source, start, stop, cue) with transition, transition_seconds, transition_reason.

    A row's transition is shortened by its own cue, though the cue is at its end.
    """
    w = Window.partitionBy(*group).orderBy(order)
    own, before = F.col("stop") - F.col("start"), F.lag(F.col("stop") - F.col("start")).over(w)
    work = rows.withColumns({"t_first": F.row_number().over(w) == 1, "t_before": F.coalesce(before, F.lit(0.0)), "t_same": F.coalesce(F.lag("source").over(w) == F.col("source"), F.lit(False))})
    asked, reason = F.lit(S.FADE_DEFAULT), F.lit("cross-dissolve across a Source Clip change")
    for cue, (seconds, text) in AT_CUE.items():
        asked, reason = F.when(F.col("cue") == cue, seconds).otherwise(asked), F.when(F.col("cue") == cue, text).otherwise(reason)
    hosts = S.can_host(F.col("t_before"), own)
    name = F.when(F.col("t_first"), F.when(hosts, "fade").otherwise("cut")).otherwise(F.when(F.col("t_same") | ~hosts, "cut").otherwise("dissolve"))
    work = work.withColumn("transition", name)
    cut = F.col("transition") == "cut"
    return work.withColumns({
        "transition_seconds": F.when(cut, F.lit(0.0)).otherwise(S.bound_transition(F.when(F.col("t_first"), S.FADE_DEFAULT + 0.1).otherwise(asked), F.col("t_before"), own)),
        "transition_reason": F.when(cut, F.lit("")).otherwise(F.when(F.col("t_first"), "opening fade in from black").otherwise(reason)),
    }).drop("t_first", "t_before", "t_same")


def transition_violation(rows: DataFrame, group: list[str], order: str, external: bool = False) -> DataFrame:
    """``rows`` with ``violation``, the first rule that a row's transition breaks; null if none.

    In an ``external`` plan, which may be written by hand, an absent or empty transition is an implicit cut; otherwise it
    is unsupported.
    """
    w = Window.partitionBy(*group).orderBy(order)
    n, own, before = F.row_number().over(w) - 1, F.col("stop") - F.col("start"), F.lag(F.col("stop") - F.col("start")).over(w)
    seconds, name = F.col("transition_seconds"), F.col("transition")
    absent = F.coalesce(name, F.lit("")) == ""
    implicit = F.when(F.coalesce(seconds, F.lit(0.0)) != 0, "implicit cut must not carry a duration") if external else F.lit("unsupported transition")
    rule = (
        F.when(absent, implicit)
        .when(~name.isin(*APPROVED), "unsupported transition")
        .when(name == "cut", F.when(seconds != 0, "hard cut must not carry a duration"))
        .when((name == "fade") & (F.col("v_n") != 0), "fade is only allowed at the opening")
        .when((F.col("v_n") == 0) & (name != "fade"), "opening must be a fade or a cut")
        .when(F.btrim(F.coalesce("transition_reason", F.lit(""))) == "", "missing its justification")
        .when((seconds < S.FADE_MIN - S.EPSILON) | (seconds > S.FADE_MAX + S.EPSILON), "outside the band")
        .when(seconds > S.FADE_SHARE * own + S.EPSILON, "exceeds twenty percent of its segment")
        .when((F.col("v_n") > 0) & (seconds > S.FADE_SHARE * F.col("v_before") + S.EPSILON), "exceeds twenty percent of the preceding segment")
    )
    return rows.withColumns({"v_n": n, "v_before": before}).withColumn("violation", rule).drop("v_n", "v_before")


def speech_within(windows: DataFrame, spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``windows`` (keys, low, high) with the seconds of spans (keys, s, e) inside [low, high]; overlapping spans add up."""
    inside = windows.join(spans, keys).withColumn("x", F.least("e", "high") - F.greatest("s", "low")).filter("x > 0 AND high > low")
    return windows.join(inside.groupBy(*keys).agg(F.sum("x").alias(name)), keys, "left").withColumn(name, F.coalesce(name, F.lit(0.0)))


def continuity(rows: DataFrame, spans: DataFrame, group: list[str], order: str) -> DataFrame:
    """(group, from_segment, to_segment, kind, seconds) where speech runs to both sides of a cut."""
    keys = [*group, order]
    ends = rows.select(*keys, (F.col("stop") - WINDOW).alias("low"), F.col("stop").alias("high"))
    heads = rows.select(*keys, F.col("start").alias("low"), (F.col("start") + WINDOW).alias("high"))
    tail = speech_within(ends, spans, keys, "tail").select(*keys, "tail")
    both = tail.join(speech_within(heads, spans, keys, "head").select(*keys, "head"), keys)
    w = Window.partitionBy(*group).orderBy(order)
    paired = both.withColumns({"next": F.lead("head").over(w), "to_segment": F.lead(order).over(w)}).filter((F.col("tail") >= MIN_SPEECH) & (F.col("next") >= MIN_SPEECH))
    kind = F.when(F.col("next") > F.col("tail"), "J-cut").otherwise("L-cut")
    return paired.select(*group, F.col(order).alias("from_segment"), "to_segment", kind.alias("kind"), S.round_ms(F.greatest("tail", "next")).alias("seconds"))


def overlaps(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows (source, start, stop) that start before the row before them in their source has ended."""
    before = F.lag("stop").over(Window.partitionBy(*group, "source").orderBy("start", "stop"))
    return rows.withColumn("before_stop", before).filter(F.col("start") < F.col("before_stop"))


def timeline(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``rows`` with ``offset``, where each starts on the joined timeline, and ``reached``, its length so far."""
    w = Window.partitionBy(*group).orderBy(order)
    first = F.row_number().over(w) == 1
    shared = F.when(first | ~F.col("transition").isin(*OVERLAPPING), 0.0).otherwise(F.col("transition_seconds"))
    work = rows.withColumn("l_shared", shared).withColumn("l_own", F.col("stop") - F.col("start") - F.col("l_shared"))
    reached = F.sum("l_own").over(w.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("l_own").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return work.withColumns({"reached": reached, "offset": F.greatest(before - F.col("l_shared"), F.lit(0.0))}).drop("l_shared", "l_own")


def branches(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``rows`` with the source's number by first appearance, the row's branch in it, and the source's rows."""
    of = Window.partitionBy(*group, "source")
    work = rows.withColumns({"b_first": F.min(order).over(of), "branch": (F.row_number().over(of.orderBy(order)) - 1).cast("bigint"), "branches": F.count("*").over(of)})
    return work.withColumn("input", (F.dense_rank().over(Window.partitionBy(*group).orderBy("b_first")) - 1).cast("bigint")).drop("b_first")


def fades(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``rows`` with head_colour, head_seconds, tail_colour, tail_seconds; the last row fades out to black."""
    w = Window.partitionBy(*group).orderBy(order)
    colour = lambda c: F.when(c == "dip-black", "black").when(c == "dip-white", "white")
    after, after_seconds = F.lead("transition").over(w), F.lead("transition_seconds").over(w)
    head = F.when(F.col("transition") == "fade", "black").otherwise(colour(F.col("transition")))
    closing = S.bound_transition(F.lit(S.FADE_DEFAULT + 0.1), F.lit(0.0), F.col("stop") - F.col("start"))
    work = rows.withColumns({"f_after": after, "f_seconds": after_seconds, "head_colour": head})
    tail = F.when(F.col("f_after").isNull(), "black").otherwise(colour(F.col("f_after")))
    work = work.withColumns({"head_seconds": F.when(F.col("head_colour").isNotNull(), F.col("transition_seconds")), "tail_colour": tail})
    return work.withColumn("tail_seconds", F.when(F.col("f_after").isNull(), closing).when(F.col("tail_colour").isNotNull(), F.col("f_seconds"))).drop("f_after", "f_seconds")


def rule_report(plans: DataFrame) -> DataFrame:
    """(plan, rule): the first rule that a plan row breaks; null if it keeps all.

    Columns: intent, audio, music (struct of path, mark, duration, fade, n_beats; null without a track), duck, language
    (null without dialogue), language_source, continuity (array of kind, seconds, from_segment, to_segment), model,
    target, n_segments.
    """
    music, none = F.col("music"), F.lit(False)
    blank = lambda c: F.coalesce(F.regexp_replace(c, r"(?U)\s+", ""), F.lit("")) == ""
    track, speech = F.col("audio") == "music", F.col("language").isNotNull()
    any_cut = lambda test: F.coalesce(F.exists("continuity", test), none)
    checks = [
        (~F.col("intent").isin("chronological", "thematic"), "unknown edit intent"),
        (~F.col("audio").isin("source", "music"), "unsupported audio source"),
        (track & music.isNull(), "music source is missing its track settings"),
        (track & blank(music["path"]), "track is missing its path"),
        (track & blank(music["mark"]), "track is missing its fingerprint"),
        (track & (music["duration"] <= 0), "track duration must be positive"),
        (track & (music["fade"] < 0), "track fade must not be negative"),
        (track & (music["n_beats"] == 0), "track has no recorded beats"),
        (~track & music.isNotNull(), "source must not carry track settings"),
        (~speech & (F.coalesce(F.size("continuity"), F.lit(0)) > 0), "continuity without dialogue settings"),
        (speech & blank(F.col("language")), "dialogue is missing its language"),
        (speech & ~F.col("language_source").isin("detected", "override"), "unsupported language source"),
        (speech & ~F.col("duck").isin("subtle", "balanced", "strong"), "unsupported ducking profile"),
        (any_cut(lambda c: ~c["kind"].isin("J-cut", "L-cut")), "unsupported continuity kind"),
        (any_cut(lambda c: c["seconds"] <= 0), "continuity duration must be positive"),
        (any_cut(lambda c: c["to_segment"] != c["from_segment"] + 1), "continuity must bridge adjacent segments"),
        (blank(F.col("model")), "missing the ranking model identity"),
        (F.coalesce(F.col("target"), F.lit(0.0)) <= 0, "target duration must be positive"),
        (F.col("n_segments") == 0, "no selected segments"),
    ]
    rule = F.lit(None).cast("string")
    for broken, text in reversed(checks):
        rule = F.when(F.coalesce(broken, none), text).otherwise(rule)
    return plans.withColumn("rule", rule)


def plan_report(plans: DataFrame, rows: DataFrame, key: str = "plan") -> DataFrame:
    """``plans`` with ``rule``, the first rule that a whole plan breaks: those of :func:`rule_report`, then those of its
    segments one after the other, then overlaps within a source.

    ``rows`` are segments (key, ord, source, start, stop, transition, transition_seconds, transition_reason, score, cue);
    score is null without one, cue null or empty where the cut was not snapped.
    """
    own = transition_violation(rows, [key], "ord")
    broken = (
        F.when(F.col("start") < 0, "segment start is negative")
        .when(F.col("stop") <= F.col("start"), "segment end is not after its start")
        .when(F.col("violation").isNotNull(), F.col("violation"))
        .when(F.col("score").isNull(), "segment is missing its AI score")
        .when((F.coalesce("cue", F.lit("")) != "") & ~F.col("cue").isin(*AT_CUE), "unsupported music cue")
    )
    first = own.withColumn("broken", broken).filter("broken IS NOT NULL").groupBy(F.col(key).alias("s_key")).agg(F.min_by("broken", "ord").alias("s_rule"))
    before = F.lag("stop").over(Window.partitionBy(key, "source").orderBy("start"))
    over = rows.withColumn("before", before).filter(F.col("start") < F.col("before")).select(F.col(key).alias("o_key")).distinct()
    met = rule_report(plans).join(first, F.col(key) == F.col("s_key"), "left").join(over, F.col(key) == F.col("o_key"), "left")
    rule = F.coalesce("rule", "s_rule", F.when(F.col("o_key").isNotNull(), "overlapping selected ranges"))
    return met.withColumn("rule", rule).drop("s_key", "s_rule", "o_key")


def with_transcripts(rows: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``dialogue``, the array of (s, e, text) of their spans (keys, s, e, text) in time order; empty without."""
    own = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("s", "e", "text"))).alias("dialogue"))
    return rows.join(own, keys, "left").withColumn("dialogue", F.coalesce("dialogue", F.array().cast(own.schema["dialogue"].dataType)))


def stabilised(rows: DataFrame) -> DataFrame:
    """Rows that need stabilising become intermediates of their own, which start at 0."""
    need, own = F.col("needs_stabilisation"), F.col("stop") - F.col("start")
    return rows.withColumns({"stop": F.when(need, own).otherwise(F.col("stop")), "start": F.when(need, 0.0).otherwise(F.col("start")), "needs_stabilisation": F.lit(False)})
