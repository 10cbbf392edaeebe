"""A training corpus from raw documents: quality, near duplicates, personal data, source mix, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and each works on
everything that the one before kept. All but the last return the columns of ``documents``; ``n_chars`` follows the text
where a stage rewrites it.

1. quality: the attention-based classifier, fitted on labelled rows; documents that score below 0.5 go.
2. near_duplicates: shingles of five words, similarity 0.8 or more; the document of least id of each component stays.
3. pii: identifiers, plain and disguised, are replaced by their kind in angle brackets.
4. mixing: sources are brought to their target shares; a document comes once for every epoch that takes it.
5. tokens: byte-level BPE ids, packed as little-endian unsigned 32-bit integers, with digests of them and of the
   decoded text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, near_join, pii, quality_mil, source_mixing
from tessel.session import checkpoint
from tessel.sources.tables import table

#: Near duplicates of the corpus: five words, four fifths.
NEAR = near_join.Rule(words=5, num=4, den=5)
KEEP_AT = 0.5


def _recounted(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives 0.5 or more.

    Defined cases: a null text is judged as an empty one; repeated rows are judged alike, each by itself; a null id is no
    hindrance, as the text is the only input of a score; without labels of both kinds all stay; an empty table gives an
    empty result; further columns, whatever their names, pass through.
    """
    model = quality_mil.train(table(spark, sf_dir, "labels"), docs)
    name = "score"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return quality_mil.score(docs, model, name=name).filter(F.col(name) >= KEEP_AT).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document of least id; a null id comes before all others.

    Defined cases: null and blank texts are near nothing and all stay; of repeated rows one stays; rows of one id with
    different texts are different documents; a text of fewer than five words is near equal texts only.
    """
    return near_join.keep_one(docs, NEAR)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its identifiers replaced by ``<kind>``. A null text stays null, and so does its n_chars."""
    return _recounted(pii.redact(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut at its budget.

    Defined cases: null and blank texts have no words and aren't taken; null sources are one source, the last; repeated
    rows and rows of one id are documents of their own; an empty table gives an empty result.
    """
    return _recounted(source_mixing.materialise(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) of every row; a null text has no tokens, like an empty one."""
    path = bpe.default_path()
    back = bpe.recode(docs, path)
    count = (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return back.select("doc_id", count, "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pii", personal_data), ("mixing", mixing), ("tokens", tokens)]

#: SQL can express neither the classifier nor the tokenizer; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
