"""A corpus pipeline of five stages; each calls one operator of weftline.llm and hands whole documents on.

Every stage but the last returns the columns of documents and works on all rows that the one before kept. Defined results: a null or
empty text fails the base rule of the first stage and goes; without labels of both classes the base rule alone decides; without benchmark items nothing
leaks; rows that repeat a doc_id are judged each for itself by the rules, all stay or go together where near duplicates or leaks are told by
id, and of rows with different texts under one id those go whose component has a smaller id; rows with a null id are no near duplicates and leak
nothing, as no other row can be meant by them; ties go to the smallest id; very long texts are read whole; an empty table gives no rows;
columns beside those of documents are dropped, whatever their names. :func:`run` deletes each stage's table once the next one is written.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftline.llm import decontaminate, quality_rules, secret_scan, sentence_pieces, simhash
from weftline.llm.common import shared_dir, table
from weftline.session import delete

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Independent fingerprints of a text in the second stage; one alone misses most copies at a similarity of 0.8 to 0.9.
REPETITIONS = 6


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the rules reject go."""
    learned = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.passing(docs.select(*COLUMNS), learned)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each component stays, the one with the smallest id; documents link by any of REPETITIONS fingerprints."""
    return simhash.representatives(docs.select(*COLUMNS), repetitions=REPETITIONS)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents that leak a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: every secret in a text is replaced by a mark; all documents stay."""
    return secret_scan.redacted(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: the ids of every text, with whether decoding gives it back."""
    return sentence_pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", rules),
    ("simhash", near_duplicates),
    ("decontaminate", benchmarks),
    ("secret_scan", secrets),
    ("sentence_pieces", tokens),
]

#: Fingerprints, learned rules and segmentation have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, root, before = table(spark, sf_dir, "documents"), shared_dir(spark), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{name}")
            docs = spark.read.parquet(f"{root}/{name}")
            if before:
                delete(spark, before)
            before = f"{root}/{name}"
    return docs
