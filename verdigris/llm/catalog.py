"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import align, bpe, convtrie, jaccard, langid, lines, mixing, nearest, segmentations, simhash, substrings, tokenfile, toxicity
from verdigris.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to 150 % of their words, source weights 3, 1, 2."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_segmentations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best segmentation and three distinct sampled ones of every text, all decoded again."""
    import public_tokenizers

    return segmentations.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned from the documents that are not held out."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = langid.held_out(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    langs, prob = langid.train(docs.where(~F.col("held_out")), model)
    return langid.predict(docs, langs, prob, model, ["doc_id", "held_out"])


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every vector whose id is divisible by 50."""
    rows = nearest.usable(table(spark, sf_dir, "embeddings"))
    return nearest.search(rows, rows.where(F.col("id") % 50 == 0))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle counts and near-duplicate components of all documents."""
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that are within two edits of an earlier class member."""
    return lines.report(table(spark, sf_dir, "documents"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written as blocks and read back."""
    import public_tokenizers

    file = tokenfile.write_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_documents(file)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    labels = toxicity.held_out(table(spark, sf_dir, "labels")).where(~F.col("held_out"))
    scored = toxicity.held_out(toxicity.score(docs, toxicity.train(docs, labels)))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_sentences", "n_offending", "worst")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return simhash.edited_likeness(table(spark, sf_dir, "documents"))


def op10_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of 20-word windows that start earlier elsewhere."""
    return substrings.removed(table(spark, sf_dir, "documents")).drop("spans")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and the texts they decode to, as digests."""
    import public_tokenizers

    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, aligned by their bytes."""
    import public_tokenizers

    return align.report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return convtrie.report(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_mixing, op2_segmentations, op3_language_id, op4_nearest, op5_jaccard, op6_lines, op7_token_file, op8_toxicity, op9_fingerprints, op10_substrings, op11_bpe, op12_alignment, op13_conversation_trie, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.MIX_SQL, "op13_conversation_trie": convtrie.TRIE_SQL}
