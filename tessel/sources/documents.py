"""Document sources and sinks: clip listings, probe documents, transcripts, catalogues, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions import scalars as S

SUFFIXES = (".avi", ".m2ts", ".mkv", ".mov", ".mp4")
PROBE = "struct<streams:array<struct<width:int,height:int,color_transfer:string,tags:struct<rotate:string>,side_data_list:array<struct<rotation:int>>>>,format:struct<duration:string,tags:struct<creation_time:string>>>"
TRANSCRIPT = "struct<result:struct<language:string>,transcription:array<struct<offsets:struct<`from`:int,`to`:int>,text:string>>>"
CATALOGUE = "struct<models:array<struct<type:string,key:string,capabilities:struct<vision:boolean>>>>"
PLAN = "version string, intent string, segments array<struct<source:string,mark:string,start:double,stop:double,transition:string>>"


def split_listing(paths: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(path, suffix, kept, reason) of a folder's files: hidden names and excluded paths don't count at all."""
    rows = paths if excluded is None else paths.join(excluded.select("path"), "path", "left_anti")
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    kept = F.col("suffix").isin(*SUFFIXES)
    return rows.filter(~name.startswith(".")).select("path", suffix.alias("suffix")).withColumns({"kept": kept, "reason": F.when(~kept, "unsupported file type")})


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, mtime) of the files of a folder, without their contents. Names that begin with _ stay hidden."""
    found = spark.read.format("binaryFile").load(folder)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def parse_probe(probes: DataFrame) -> DataFrame:
    """(path, duration, captured_at, width, height, hdr, reason) from (path, json, mtime); a bad document gives a reason."""
    p = F.from_json("json", PROBE)
    parsed = probes.select("path", "mtime", p.alias("p")).withColumn("s", F.get("p.streams", F.lit(0)))
    duration = F.col("p.format.duration").try_cast("double")
    width, height = S.display_size(F.col("s.width"), F.col("s.height"), S.rotation(F.col("s.side_data_list"), F.col("s.tags.rotate")))
    bad = duration.isNull() | (duration <= 0) | F.col("s").isNull()
    at = F.coalesce(F.try_to_timestamp("p.format.tags.creation_time"), F.col("mtime"))
    return parsed.select("path", duration.alias("duration"), at.alias("captured_at"), width.alias("width"), height.alias("height"), F.coalesce(F.col("s.color_transfer").isin("smpte2084", "arib-std-b67"), F.lit(False)).alias("hdr"), F.when(bad, "unreadable probe").alias("reason"))


def skipped(listed: DataFrame, probed: DataFrame) -> DataFrame:
    """(path, reason) of every file left out: by its type in a listing (path, reason), or by its probe (path, reason)."""
    return listed.select("path", "reason").unionByName(probed.select("path", "reason")).filter("reason IS NOT NULL")


def collisions(artifacts: DataFrame, sources: DataFrame) -> DataFrame:
    """(artifact, source) paths of artifacts (path, file) that would overwrite a source (path, file): file is the identity
    of an existing file, null where there is none."""
    return artifacts.select(F.col("path").alias("artifact"), F.col("file").alias("a_file")).join(sources.select(F.col("path").alias("source"), "file"), F.col("a_file") == F.col("file")).select("artifact", "source")


def capture_order(clips: DataFrame, group: list[str] | None = None) -> DataFrame:
    """``clips`` with ``clip_ord``: by capture time, then by name."""
    from pyspark.sql import Window

    w = (Window.partitionBy(*group) if group else Window).orderBy("captured_at", F.element_at(F.split("path", "/"), -1))
    return clips.withColumn("clip_ord", (F.row_number().over(w) - 1).cast("bigint"))


def parse_transcript(rows: DataFrame) -> DataFrame:
    """(path, language, s, e, text) from (path, start, json): milliseconds become seconds, shifted by the clip's start."""
    t = rows.select("path", "start", F.from_json("json", TRANSCRIPT).alias("t")).select("path", "start", F.col("t.result.language").alias("language"), F.explode("t.transcription").alias("x"))
    s, e = (F.col("start") + F.col(f"x.offsets.`{k}`") / 1000 for k in ("from", "to"))
    return t.select("path", "language", s.alias("s"), e.alias("e"), F.btrim("x.text").alias("text")).filter("e > s")


def vision_models(catalogue: DataFrame) -> DataFrame:
    """The keys of language models with vision from (json)."""
    m = catalogue.select(F.explode(F.from_json("json", CATALOGUE)["models"]).alias("m"))
    return m.filter("m.type = 'llm' AND m.capabilities.vision").select(F.col("m.key").alias("key"))


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A plan document, refused where its version or its segments are not right."""
    plan = spark.read.schema(PLAN).option("multiLine", True).json(path)
    ok = (F.col("version") == "1") & (F.size("segments") > 0)
    return plan.withColumn("version", F.when(ok, F.col("version")).otherwise(F.raise_error(F.lit("not a plan of version 1 with segments"))))


def write_plan(plan: DataFrame, path: str, force: bool = False) -> None:
    """One JSON document; an existing one is replaced only with ``force``."""
    plan.coalesce(1).write.mode("overwrite" if force else "errorifexists").json(path)


def encode_plan(plan: DataFrame) -> DataFrame:
    """(json): the document with indentation; empty text, false and empty lists of optional fields are left out."""
    return plan.select(F.to_json(F.struct(*plan.columns), {"pretty": "true"}).alias("json"))
