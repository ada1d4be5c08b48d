"""From raw documents to token ids: five stages, each by one operator of ``spindrift.llm``.

Each stage takes other columns along, whatever their names, and an empty table stays empty.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept;
between stages the rows are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontam, langid, linededup, simhash
from spindrift.llm.common import kept_table, ship, table

#: Documents whose best language scores less than this are rejected, as are those without letters.
MIN_LANGUAGE_SCORE = 0.1


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the classifier knows; without labelled rows, all with letters.

    Null and empty texts and texts without letters go. Equal texts fare alike, equal scores go to the first language by name; repeated rows
    stay or go together.
    """
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep(docs, model, MIN_LANGUAGE_SCORE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of three or more lines, or of 50 or more words; every document stays, with n_chars counted anew.

    The first place in order of doc_id and line stays. Null and empty texts stay as they are; rows of one doc_id count as one document.
    """
    done = linededup.dedup_lines(docs, min_lines=3, min_words=50)
    return done.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else done[c] for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near copies (five-word Jaccard similarity of 0.8 or more).

    Null texts, empty ones and those of white space are one class. All rows of a doc_id that is kept stay.
    """
    ship(spark)
    gone = simhash.near_copies(docs, width=5, least=0.8).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with an item of the benchmark.

    Null and empty texts overlap with nothing, and null and empty items neither. If one row of a doc_id overlaps, all rows of it go.
    """
    gone = decontam.overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes each text; digests of the ids and of the decoded bytes. Null and empty texts have no ids; each row has its own."""
    import public_tokenizers

    ship(spark)
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, held=400_000)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokens", tokens)]

#: Classification and fingerprints can't be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = kept_table(docs, name)
    return docs
