"""The queries of the operators over their whole tables, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.llm import (
    language, lines, mixing, near_dup, neighbours, pieces, prefix_trie, private, quality, quality_rules, repair, token_files, toxicity,
)
from tallystream.llm.shared import remainder
from tallystream.llm.sql import MIXING_SQL, PRIVATE_SQL, QUALITY_RULES_SQL
from tallystream.session import read_table


def op1_language(spark: SparkSession, directory: str) -> DataFrame:
    """Predicted language of every document; learned where crc32 of the id modulo 3 is not 1."""
    docs = read_table(spark, directory, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = language.fit(docs, ~held_out)
    return language.predicted(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


def op2_private(spark: SparkSession, directory: str) -> DataFrame:
    """Counts, digest and list of the personal data of every document."""
    found = private.private_spans(read_table(spark, directory, "documents").select("doc_id", "text"))
    base = private.written(F.filter("private", lambda s: s["kind"].isin(*private.PATTERNS)))
    return found.select(
        "doc_id", *[f"n_{k}" for k in private.PATTERNS], F.sha2(base, 256).alias("base_sha256"),
        private.written(F.col("private")).alias("spans"),
        F.size(F.filter("private", lambda s: ~s["kind"].isin(*private.PATTERNS))).cast("long").alias("n_added"))


def op3_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """Toxicity of every document; learned where crc32 of the id modulo 5 is not 0."""
    docs = read_table(spark, directory, "documents")
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    labels = read_table(spark, directory, "labels").filter(~held_out).select("doc_id", "toxic")
    model = toxicity.fit(docs, labels)
    return toxicity.scored(docs.select("doc_id", "text", held_out.alias("held_out")), model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op4_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Lines of every document, how many went as recurring templates, and a digest of the text that is left."""
    docs = read_table(spark, directory, "documents").select("doc_id", "text")
    size = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    return lines.without_repeated_lines(docs.withColumn("n_lines", size), count="n_dropped").select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op5_sentencepiece(spark: SparkSession, directory: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back."""
    docs = read_table(spark, directory, "documents").select("doc_id", "text")
    vocabulary = pieces.read_vocabulary(pieces.MODEL)
    both = pieces.round_trip(docs, vocabulary)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), F.col("text").eqNullSafe(F.col("decoded")).alias("round_trip"),
        "ids")


def op6_quality(spark: SparkSession, directory: str) -> DataFrame:
    """Quality of every document; its source is the host, source and language are the path."""
    docs = read_table(spark, directory, "documents")
    model = quality.fit(docs, read_table(spark, directory, "labels").select("doc_id", "quality"))
    return quality.quality(docs, model, F.col("source"), F.col("lang"))


def op7_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector."""
    return neighbours.nearest(read_table(spark, directory, "embeddings"), F.col("id") % 20 == 0)


def op8_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Counts and verdict of every document under thresholds of its language and source."""
    return quality_rules.quality_rules(read_table(spark, directory, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level")


def op9_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    """Component and verdict of every document under shared 4-word shingles."""
    return near_dup.near_duplicates(read_table(spark, directory, "documents"))


def op10_mixing(spark: SparkSession, directory: str) -> DataFrame:
    """What the mix takes of every document, in the order of first training positions."""
    plan = mixing.mix_plan(read_table(spark, directory, "documents"))
    first = F.get("positions", F.lit(0))
    return plan.select(
        "doc_id", "size", "source_size", "target", "taken", "copies", first.alias("position")
    ).orderBy(F.asc_nulls_last("position"), "doc_id")


def op11_prefix_trie(spark: SparkSession, directory: str) -> DataFrame:
    """All nodes of the trie of conversations whose openings are shared within families of a hundred."""
    turns = prefix_trie.turn_sequences(read_table(spark, directory, "conversations"))
    return prefix_trie.prefix_trie(prefix_trie.with_shared_openings(turns))


def op12_conversation_repair(spark: SparkSession, directory: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every conversation, after known damage."""
    rows = read_table(spark, directory, "conversations")
    return repair.report_digests(repair.repair(repair.damaged(rows), rows.select("conv_id")))


def op13_token_files(spark: SparkSession, directory: str) -> DataFrame:
    """Place, length and digest of the token ids of every document, from files of directly addressable codes."""
    docs = read_table(spark, directory, "documents")
    manifest = token_files.write_tokens(docs, token_files.new_folder(docs))
    return token_files.read_summaries(manifest)


QUERIES = {
    "op1_language": op1_language,
    "op2_private": op2_private,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality": op6_quality,
    "op7_neighbours": op7_neighbours,
    "op8_quality_rules": op8_quality_rules,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_mixing": op10_mixing,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_files": op13_token_files,
}

ORACLES = {
    "op2_private": PRIVATE_SQL,
    "op8_quality_rules": QUALITY_RULES_SQL,
    "op10_mixing": MIXING_SQL,
}
