"""Content keys, incremental work against a memo table, fingerprint checks, required against available."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The first codec is the hardware one.
HARDWARE, SOFTWARE, CRF = "h264_videotoolbox", "libx264", 20


def split_work(wanted: DataFrame, memo: DataFrame, key: str = "key") -> DataFrame:
    """``wanted`` with the memo's columns where its key is known and ``hit``; corrupt or absent entries are misses."""
    known = memo.filter("value IS NOT NULL").dropDuplicates([key]).withColumn("hit", F.lit(True))
    return wanted.join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def new_entries(computed: DataFrame, memo: DataFrame, key: str = "key") -> DataFrame:
    """What is to be appended to the memo: computed rows whose key it lacks, each once."""
    return computed.dropDuplicates([key]).join(memo.select(key), key, "left_anti")


def source_problems(plan: DataFrame, current: DataFrame) -> DataFrame:
    """``plan`` (source, mark, start, stop) with ``problem``, the first that applies to a row; null if none."""
    found = plan.join(current.select("source", F.col("mark").alias("actual"), F.lit(True).alias("there")), "source", "left")
    problem = (
        F.when(F.coalesce("mark", F.lit("")) == "", "missing a source fingerprint")
        .when(F.col("stop") <= F.col("start"), "empty range")
        .when(F.col("there").isNull(), "source is missing")
        .when(~F.col("actual").eqNullSafe(F.col("mark")), "source changed")
    )
    return found.withColumn("problem", problem).drop("actual", "there")


def problem_lists(problems: DataFrame, group: list[str], order: str, name: str = "source") -> DataFrame:
    """(group, n_problems, report): all problems of a group's rows together, in order; groups without any are left out."""
    line = F.concat(F.col(name).cast("string"), F.lit(": "), F.col("problem"))
    found = problems.filter("problem IS NOT NULL").groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))).alias("lines"))
    return found.select(*group, F.size("lines").cast("bigint").alias("n_problems"), F.concat(F.size("lines").cast("string"), F.lit(" source problem(s):\n  "), F.array_join("lines.line", "\n  ")).alias("report"))


def music_problems(plans: DataFrame, current: DataFrame) -> DataFrame:
    """``plans`` (music: struct of path and mark, or null) with ``problem``, the first that applies to its track; null if
    none, and without a track. ``current`` has (path, mark) of the tracks that are there."""
    found = plans.join(current.select(F.col("path").alias("c_path"), F.col("mark").alias("actual"), F.lit(True).alias("there")), F.col("music.path") == F.col("c_path"), "left")
    problem = F.when(
        F.col("music").isNotNull(),
        F.when(F.btrim(F.coalesce("music.path", F.lit(""))) == "", "track has no path")
        .when(F.coalesce("music.mark", F.lit("")) == "", "missing the track fingerprint")
        .when(F.col("there").isNull(), "track is missing")
        .when(~F.col("actual").eqNullSafe(F.col("music.mark")), "track changed"),
    )
    return found.withColumn("problem", problem).drop("c_path", "actual", "there")


def append_entries(computed: DataFrame, path: str, by: str = "category") -> None:
    """Append rows (by, key, value, ...) to the memo table at ``path``, in one folder for each category. Entries are only
    ever added, so a run that is stopped leaves a memo that can be read; ``new_entries`` says which to add."""
    computed.write.mode("append").partitionBy(by).parquet(path)


def capability_names(text: DataFrame) -> DataFrame:
    """(kind, name) from (kind, raw): the second field of each line; short lines and legend lines don't count."""
    fields = text.select("kind", F.explode(F.split("raw", "\n")).alias("line")).withColumn("f", F.split(F.btrim("line"), r"\s+"))
    return fields.filter((F.size("f") >= 2) & (F.get("f", F.lit(1)) != "=")).select("kind", F.get("f", F.lit(1)).alias("name")).distinct()


def missing(required: DataFrame, available: DataFrame) -> DataFrame:
    return required.join(available, ["kind", "name"], "left_anti")


def choose_encoder(mode, available):
    """The codec for a mode from an array of names; null where it isn't to be had."""
    has = lambda name: F.array_contains(available, name)
    return F.when(mode.isin("auto", "hardware") & has(HARDWARE), HARDWARE).when(mode.isin("auto", "software") & has(SOFTWARE), SOFTWARE)
