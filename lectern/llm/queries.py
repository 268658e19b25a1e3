"""The training-data queries: thin digests of the operators over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import centroid_clustering, chat_format, decontamination, html_extraction, language_id, lexical_search, minhash, packing, pii, quality_classifier, quality_rules, token_rollup, web_archive
from lectern.llm.common import crc_mod, persist_shared, read, shared_dir


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return html_extraction.digest(html_extraction.extract(read(spark, sf_dir, "pages")))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's line-first measures and verdict."""
    return quality_rules.digest(quality_rules.measure(read(spark, sf_dir, "documents")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data: base counts, a hash of the base spans, all spans."""
    docs = read(spark, sf_dir, "documents")
    return pii.digest(pii.find(docs, pii.fit(docs)))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals after a load of all documents, a recount of those not in English, and a withdrawal of short ones.

    The recount is committed twice, as after a lost driver, and counts once.
    """
    counts = persist_shared(token_rollup.count_tokens(read(spark, sf_dir, "documents")), "token-counts")
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", token_rollup.signed(token_rollup.version(counts, "words-v1").unionByName(token_rollup.version(counts, "bytes-v1")), 1))
    foreign = counts.where("coalesce(lang, '') <> 'en'")
    recount = token_rollup.revised(token_rollup.version(foreign, "words-v1"), token_rollup.version(foreign, "words-v2"))
    rollup.commit("recount", recount)
    rollup.compact()
    short = counts.where("`words-v1` < 20")
    gone = [token_rollup.version(short.where(c), v) for v, c in (("words-v1", "lang = 'en'"), ("words-v2", "coalesce(lang, '') <> 'en'"), ("bytes-v1", "true"))]
    rollup.commit("withdrawal", token_rollup.signed(gone[0].unionByName(gone[1]).unionByName(gone[2]), -1))
    rollup.commit("recount", recount)
    return rollup.totals()


def token_counts_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of real token ids: all documents, those of ``src1`` withdrawn and counted anew by another version; commits are repeated."""
    at = {"byte-bpe-50k": token_rollup.vocabulary_tokens(), "words-v2": token_rollup.letter_runs}
    counts = persist_shared(token_rollup.count_tokens(read(spark, sf_dir, "documents"), at), "vocabulary-counts")
    rollup = token_rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")
    one = counts.where("source = 'src1'")
    for _ in range(2):
        rollup.commit("load", token_rollup.signed(token_rollup.version(counts, "byte-bpe-50k"), 1))
        rollup.commit("recount", token_rollup.revised(token_rollup.version(one, "byte-bpe-50k"), token_rollup.version(one, "words-v2")))
    return rollup.totals()


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; rows of fold 1 are never learnt from."""
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs.select("doc_id", "text"), language_id.fit(docs, crc_mod("doc_id", 3) != 1))
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in windows of 1024 tokens: one row per piece."""
    return packing.digest(packing.pack_documents(read(spark, sf_dir, "documents"), added=True))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark items whose passages it holds."""
    return decontamination.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, written as a marked transcript, in canonical turns: what the parser makes of its lines.

    The model learns from transcripts with known roles; the parser sees lines alone.
    """
    lines = chat_format.transcripts(read(spark, sf_dir, "conversations"))
    return chat_format.parse(lines.drop("role", "opened_at"), chat_format.fit(lines))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of fold 2 are never learnt from."""
    scored = quality_classifier.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the least id of its near-duplicate class."""
    classes = minhash.near_duplicates(read(spark, sf_dir, "documents"))
    return classes.withColumn("is_kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's fifty best documents."""
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector of 64 components in one of forty clusters after five rounds."""
    return centroid_clustering.cluster(read(spark, sf_dir, "embeddings"))


def op13_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its archive record says: written, indexed, looked up by its address and read back by range."""
    pages, at = read(spark, sf_dir, "pages"), f"{shared_dir(spark)}/archive-{uuid.uuid4().hex}"
    shards = web_archive.write_index(web_archive.write(pages, at), f"{at}/index")
    captures = persist_shared(web_archive.find(pages.select(web_archive.url_key(F.col("url")).alias("url_key")), shards, f"{at}/index"), "found-captures")
    return web_archive.resolved(web_archive.read_records(captures, at))


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "token_counts_vocabulary": token_counts_vocabulary,
    "op5_language_id": op5_language_id,
    "op6_packing": op6_packing,
    "op7_decontamination": op7_decontamination,
    "op8_chat_format": op8_chat_format,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_minhash": op10_minhash,
    "op11_lexical_search": op11_lexical_search,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_web_archive": op13_web_archive,
}
ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": quality_rules.ORACLE_SQL,
    "op4_token_counts": token_rollup.ORACLE_SQL,
    "op7_decontamination": decontamination.ORACLE_SQL,
    "op8_chat_format": chat_format.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_centroid_clustering": centroid_clustering.ORACLE_SQL,
    "op13_web_archive": web_archive.ORACLE_SQL,
}
