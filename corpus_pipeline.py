"""The corpus pipeline: documents to packed sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as
Parquet and read again for the next. Null and empty texts, very long ones,
repeated rows, null ids, empty tables and further columns are all allowed; the
docstrings say what comes of them. All but the last return COLUMNS.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import jaccard, pack, quality, substring, toxicity
from vecloom.llm.common import drop_settled, settle, with_whole
from vecloom.llm.queries import held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the weak-label scorer finds bad.

    Every row is judged by its own text, so equal texts fare alike; null and
    empty texts score as the model has it for texts without words.
    """
    return quality.score_quality(docs.select(COLUMNS), quality.fit(docs), score="__score").where("__score >= 0.5").select(COLUMNS)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the grammar finds toxic; its stems are learned from rows that are not held out.

    Every row is judged by its own text; null and empty texts stay. Null labels
    and ids teach nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out("doc_id"))
    lexicon = toxicity.learn_lexicon(docs, labels)
    return toxicity.score_documents(docs.select(COLUMNS), lexicon, score="__score").where("__score < 0.5").select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group with Jaccard 0.8 or more of five-word shingles: that of the smallest id, one without id last.

    Texts without words (null, empty) are in no group and stay. Where ids repeat
    or are null, rows are numbered first and each is a document of its own, so
    of equal rows one stays.
    """
    docs = docs.select(COLUMNS)
    if not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count():
        roots = jaccard.jaccard_roots(docs, shingle=5, num=8, den=10)
        return docs.join(roots.where("node <> root").select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(COLUMNS)
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()))
    roots = jaccard.jaccard_roots(rows, shingle=5, num=8, den=10, id_col="__row")
    named = roots.join(rows.select(F.col("__row").alias("node"), "doc_id"), "node")
    named = named.withColumn("at", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node"))
    gone = with_whole(named, "root", "node", F.min("at"), F.min, "first").where("node <> first.node").select(F.col("node").alias("__row"))
    return rows.join(gone, "__row", "left_anti").select(COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out the words of 20-word windows that occur earlier; no row goes.

    What is left is joined by single spaces; null becomes empty. A null id
    comes before all others; of equal rows one keeps its words.
    """
    out = substring.deduplicate(docs, kept="text", carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids, a row per piece; null and empty texts are a piece of one id, repeated rows pieces of their own."""
    where = public_tokenizers.path
    return pack.pack_documents(docs, where("byte_bpe_50k.json"), where("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_filter), ("toxicity", toxicity_filter), ("near_copies", near_copies), ("repeats", repeats), ("packing", packing)]
#: SQL can express neither the models nor the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over the documents of a folder; a stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
        if before is not None:
            drop_settled(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
