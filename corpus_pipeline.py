"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
what a stage keeps as Parquet in the shared folder and reads it again as the
next one's documents. All but the last return the columns of documents, and any
others that come with them, whatever their names; an empty table passes through
all of them. Long texts are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.llm.catalog import tokenizer_path
from quillmine.llm.common import table, unused, written
from quillmine.llm.decontaminate import without_contaminated
from quillmine.llm.line_dedup import dedup_lines
from quillmine.llm.packing import pack
from quillmine.llm.simhash import first_of_near_copies
from quillmine.llm.toxicity import fit_toxicity, with_scores


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects at the threshold of their language go;
    a score equal to it is rejected. Null and empty texts are scored like others,
    long ones whole; repeated rows share their fate."""
    model = fit_toxicity(spark, docs, table(spark, sf_dir, "labels"))
    score, threshold = unused(docs.columns, "score", "threshold")
    return with_scores(spark, docs, model, names=(score, threshold)).where(F.col(score) < F.col(threshold)).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that another document, or an earlier line, has already go; so do
    documents that lose all their text by it. Whoever keeps a line stays: whether
    it is a copy is for the next stage to tell. Null and blank texts lose nothing
    and stay; of rows equal in id and text one keeps its lines. n_chars is that of
    the text that is left."""
    n_lines, n_removed = unused(docs.columns, "n_lines", "n_removed")
    done = dedup_lines(spark, docs, counts=(n_lines, n_removed))
    done = done.where((F.col(n_removed) == 0) | F.col("text").rlike(r"\S"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows that SimHash links, one stays: the one with the smallest id and, of
    equal ids, the smallest text hash; a missing id comes last. Texts without words,
    null ones too, are copies of each other, and rows equal in id and text are one."""
    return first_of_near_copies(spark, docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or nearly so, go; null and empty texts
    hold none, and repeated rows share their fate."""
    return without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each piece of a document and its place in a sequence of 2048 tokens; a null or
    empty text is one token, its end, and repeated rows are packed each."""
    return pack(spark, docs, tokenizer_path("word_bpe_49k.json"), end_id=0, capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("packing", pack_sequences),
]

#: Trained models, hashes and tokenizers have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
