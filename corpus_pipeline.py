"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the
last return the columns of ``documents``. ``run`` writes each stage's rows to the shared folder.

Stages that choose rows give each row a number first, so null and repeated doc_ids are rows like others.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import jaccard, langid, lines, mixing, segmentations
from verdigris.llm.common import settle, table


def fresh(docs: DataFrame, name: str) -> str:
    """``name``, with marks behind it until no column of ``docs`` is called so."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts and texts without a letter go. ``lang`` becomes the predicted one.

    The model is learned from the input's own labelled rows that are not held out.
    """
    model = public_tokenizers.path("piece_bpe_32k.model")
    langs, prob = langid.train(langid.held_out(docs).where(~F.col("held_out")), model)
    guess, sure = fresh(docs, "lang_pred"), fresh(docs, "score")
    told = langid.predict(docs, langs, prob, model, names=(guess, sure))
    return told.where(F.col(guess) != "und").withColumn("lang", F.col(guess)).select(*[F.col(f"`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat an earlier line; documents left without text go."""
    return lines.deduped(docs)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as a struct ``doc`` with a number of its own for every row as ``_row``, written so that it stays."""
    return settle(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest doc_id, null ids last. Rows outside any group stay."""
    rows = numbered(docs)
    classes = jaccard.joined(rows.select(F.col("_row").alias("doc_id"), F.col("doc.text").alias("text"))).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class"))
    named = settle(rows.select("_row", F.col("doc.doc_id").alias("doc_id")).join(classes, "_row"))
    first = named.groupBy("_class").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first")).select(F.col("_first._row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select("doc.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the document at a budget's edge gives its first words only."""
    rows = numbered(docs)
    mixed = mixing.mix(rows.select("_row", "doc.doc_id", "doc.text", "doc.source"), carry=["_row"])
    taken = mixed.where(F.col("taken") > 0).select("_row", F.col("epochs").alias("_epochs"), (F.col("taken") - F.col("epochs") * F.col("size")).alias("_extra"), F.col("size").alias("_size"))
    rows = rows.join(taken, "_row")
    words = F.filter(F.split("doc.text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    part = F.when(F.col("_extra") == F.col("_size"), F.col("doc.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("_extra").cast("int")), " "))
    copies = F.concat(F.array_repeat(F.lit(True), F.col("_epochs").cast("int")), F.when(F.col("_extra") > 0, F.array(F.lit(False))).otherwise(F.array().cast("array<boolean>")))
    rows = rows.withColumn("_whole", F.explode(copies)).withColumn("_text", F.when(F.col("_whole"), F.col("doc.text")).otherwise(part))
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast("long")}
    return rows.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document with two sampled segmentations."""
    return segmentations.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing", source_mix),
    ("SentencePiece encoding", encode),
]

#: Language ID, edit distances over all lines and sampling are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
