"""A training corpus from documents: stages that each rewrite what the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontamination, minhash, packing, pii, quality_classifier
from lectern.llm.common import crc_mod, forget, persist_shared, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts.

    Null and empty texts are scored as texts without words; very long ones are scored whole. Repeated rows stay or go
    together, and a score of exactly the threshold stays. Without labels, or without documents, none is kept. Columns of
    any name pass unchanged.
    """
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return docs.where(quality_classifier.score_column(model) >= quality_classifier.THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate class, the one of the least id.

    Rows of null text, and of null id, stay; of rows that repeat id and text one stays. An id with several texts is as many
    documents. Empty texts are copies of each other. An empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark.

    Null and empty texts hold none and stay; very long ones are searched whole. Rows of one id are judged by their own
    texts, repeated rows go together. Without benchmark items all stay.
    """
    found = persist_shared(decontamination.overlaps(docs, read(spark, sf_dir, "benchmark")), "contaminated")
    return decontamination.drop_contaminated(docs, found)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by the name of its kind, and count ``n_chars`` anew.

    No row is dropped: null texts stay null, empty ones empty, repeated rows are masked each, very long texts whole. Of
    spans that overlap the first stands for what both cover. Other columns pass unchanged.
    """
    return pii.mask(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token windows: one row per piece with its ids.

    Null and empty texts are the single end token; repeated rows are packed each; documents longer than a window are cut
    into full windows first; of windows that fit alike the last opened takes a piece. An empty table has no pieces.
    """
    return packing.pack_documents(docs, added=True)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", hide_personal_data),
    ("packing", pack),
]

#: The classifier and the tokenizer can't be said in SQL; the stages are tested against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, each written to the shared folder and read again; a stage's table goes once the next one is written."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        last, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persist_shared(docs, f"pipeline-{name}")
            forget(last)
    return docs
