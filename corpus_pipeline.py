"""The training-data pipeline: language, lines, near-duplicates, benchmarks, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs.  All but the last return the columns of ``documents``.

Defined cases, in every stage: null and repeated ids are no reason to go, a verdict holds for an id with its text; null and empty
texts go in the first stage, as they have no letter; repeated rows are kept until near-dedup, where one stays; further columns
travel along, whatever they are called; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.bpe import encode_documents
from sitefold.llm.common import durable, shared_folder, small
from sitefold.llm.decontam import decontaminate
from sitefold.llm.langid import identify
from sitefold.llm.neardup import near_duplicates
from sitefold.llm.templates import drop_templates

#: Lists of ids are broadcast up to so many rows.
BROADCAST_IDS = 500_000
#: Bytes of the Arrow batches that the stages exchange with Python; all stages share the executors' memory with what earlier ones left there.
BATCH_BYTES = 2 << 20
#: Similarity in percent from which two documents are copies.
SIMILAR = 80


def _lean(spark: SparkSession) -> None:
    """Bounds the Arrow batches to BATCH_BYTES; the operators keep a bound that is below their own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(str(spark.conf.get(name)).rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or with a language between two codewords, go."""
    _lean(spark)
    return identify(docs).filter(~F.col("ambiguous")).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates go, and documents that had nothing else; n_chars follows the text."""
    cut = drop_templates(docs).filter((F.col("n_dropped") == 0) | (F.btrim(F.col("row.text")) != ""))
    return cut.select("row.*").withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))


def _without(docs: DataFrame, gone: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of docs whose id and text are not in (doc_id, key), the rows of a written table."""
    side = small(gone, gone.count(), BROADCAST_IDS)
    same = docs["doc_id"].eqNullSafe(side["doc_id"]) & (F.xxhash64(docs["text"]) == side["key"])
    return docs.join(side, same, how)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component one row stays: of the smallest id, or if no row has one, of the smallest text hash.

    Rows are told apart by id and text, so other texts under the same id or without one are not touched; of rows that repeat both one
    stays.  Texts without a word are no copies of anything and stay, repeated or not.
    """
    _lean(spark)
    found = durable(near_duplicates(docs, percent=SIMILAR, by_row=True))
    extra = durable(found.filter("extra").select("doc_id", "key").distinct())
    twins = durable(found.filter("worded and not extra").groupBy("doc_id", "key").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "key"))
    rest = _without(docs, extra)
    again = _without(rest, twins, "left_semi")
    return _without(rest, twins).unionByName(again.dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; rows are told apart by id and text."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, durable(found.filter("contaminated").select("doc_id", "key").distinct()))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and the decoded text."""
    _lean(spark)
    out = encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results in between are Parquet in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
