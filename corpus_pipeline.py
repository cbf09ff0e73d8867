"""A corpus pipeline: quality, near-duplicates, decontamination, mixing, token ids.

Each stage takes what the one before it kept, with the columns of ``documents``, as a table that was written and
read again; the last one returns what its token files hold.

All stages take a table of the columns of ``documents``, others are ignored (an operator's own names among them), and no rows
give no rows.  Ids may be null or repeated: rows are told apart by id and text together, so rows that repeat both share
their fate.  Null texts count as empty.  Each stage says what becomes of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import stash
from siftline.llm.decontaminate import decontaminate
from siftline.llm.mixing import mix_texts
from siftline.llm.quality import keep_good
from siftline.llm.queries import tokenizer_path
from siftline.llm.similar import keep_one_similar
from siftline.llm.token_files import token_table
from siftline.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects; those without words never are, repeats all are or none is."""
    return keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates: five words, Jaccard similarity 0.8 or more.

    Texts without words are one group, a null id comes after all others, and of repeated rows one stays.
    """
    return keep_one_similar(docs).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark; texts without words are not, repeats share their fate."""
    bad = decontaminate(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_h")).distinct()
    same = docs.doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(docs.text) == F.col("_h"))
    return docs.join(bad, same, "left_anti").select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts of the mix: a row for each document and epoch that takes words of it; texts without words have none to take."""
    return mix_texts(docs).select(*COLUMNS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: a row for each row; null texts are the end id alone, null ids come first."""
    return token_table(docs, tokenizer=tokenizer_path(), end=0)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]

#: Hashes, samples and files are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
