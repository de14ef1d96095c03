"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of ``documents``.

* language ID drops documents in which no language is found: null texts and texts without a letter.
* line dedup drops the repeats of lines that fit a recurring template; the first stays, and so does every document
  that has a line left.
* near-duplicate removal keeps the document with the smallest id of each component of SimHash links and of
  links between texts with a Jaccard similarity of 0.8 or more in their 5-word shingles.
* mixing repeats or leaves out documents so that sources come near their target weights.
* packing returns the pieces of all documents with their places in sequences.

Every stage takes rows with a null in any column (a null text goes in the first stage; a null id or source is a value like any other),
empty and very long texts (whole), repeated rows and ties (as the stage's operator says), empty tables (no rows), and further
columns of any name, which come out of all stages but the last as they went in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statementspark.llm import langid, line_templates, mixing, near_copies, packing, simhash
from statementspark.llm.common import count_words, materialize, table


def _wrapped(docs: DataFrame) -> DataFrame:
    """Id and text beside the whole row in one column, so that no name of an input can clash with an operator's."""
    return docs.select(docs["doc_id"], docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; their columns stay as they are."""
    langs, model = langid.train(docs.where(~langid.held_out(docs["doc_id"])))
    found = langid.predict(_wrapped(docs), langs, model, keep=("row",))
    return found.where("lang_pred <> 'und'").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their text less its repeated lines; those with no line left go."""
    found = line_templates.dedup_lines(_wrapped(docs)).where("n_kept > 0 OR n_lines = 0")
    return found.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs, similarity=near_copies.SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, count_words(F.col("text")))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and seeded draws have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
