"""Classification of source files and passages by path, author and content, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import col

# Folders and the source type or corpus kind that each stands for.
SOURCE_TYPES = {"transcripts": "transcripts", "the_batch": "newsletter", "blog_posts": "blog_posts"}
CORPUS_KINDS = {"transcripts": "spoken", "the_batch": "newsletter", "blog_posts": "blog"}
# Phrases that mark a passage as a canonical example.
CANONICAL = [
    r"\blego\s+block\b", r"\blego\s+brick\b", r"\blego\b",
    r"\bcat\s+recognition\b", r"\bis\s+it\s+a\s+cat\b", r"\bnon-cat\b", r"\bcat\s+detector\b",
    r"\bhousing\s+price\b", r"\bhouse\s+price\b", r"\bhouse\s+size\b",
    r"\bspam\s+detection\b", r"\bspam\s+email\b", r"\bemail\s+classifier\b",
    r"\bwalking\s+down\s+a\s+hill\b", r"\bgradient\s+descent\b", r"\bfog\b",
    r"\bnew\s+electricity\b", r"\bintellectual\s+honesty\b",
    r"\bmars\s+overpopulation\b", r"\boverpopulation\s+on\s+mars\b",
    r"\bdata-centric\b", r"\bdata\s+centric\b",
    r"\bagentic\s+workflow\b", r"\bagentic\s+ai\b", r"\bmulti-agent\b", r"\bagentic\s+design\b",
    r"\bdon't\s+worry\b", r"\bdon't\s+worry\s+if\s+you\b", r"\bdon't\s+worry\s+about\s+it\b",
    r"\bsuperpower\b", r"\bdeep\s+learning\s+is\s+a\s+superpower\b",
]
# File names of less weight, openings that suggest the author's own voice, hints of structured documents.
LESSER_FILES = ["ambassador-spotlight", "heroes-of-deep-learning", "hodl", "working-ai"]
OWN_VOICE = ["i think", "i find", "dear friends"]
STRUCTURED_HINTS = ["cs229", "yearning", "lecture", "notes"]


def _holds(text: Column, words: list[str]) -> Column:
    return F.exists(F.lit(words), lambda w: F.contains(text, w)) if words else F.lit(False)


def folder(path: Column | str) -> Column:
    """The folder that a file stands in; empty for a bare name."""
    return F.coalesce(F.try_element_at(F.split(col(path), "/"), F.lit(-2)), F.lit(""))


def source_type(path: Column | str) -> Column:
    """The source type of a file's folder; other folders hold lectures."""
    return F.coalesce(*[F.when(folder(path) == k, v) for k, v in SOURCE_TYPES.items()], F.lit("lecture"))


def corpus_kind(path: Column | str) -> Column:
    """Spoken, newsletter, blog or written, by folder."""
    return F.coalesce(*[F.when(folder(path) == k, v) for k, v in CORPUS_KINDS.items()], F.lit("written"))


def canonical(text: Column | str) -> Column:
    """Whether a text holds a canonical example, whatever its case; a null text holds none."""
    return F.coalesce(col(text).rlike("(?i)" + "|".join(CANONICAL)), F.lit(False))


def own_text(author: Column | str, text: Column | str, names: list[str]) -> Column:
    """Whether the author, or the first 500 characters, hold one of ``names``; without an author, an opening in the own voice will do."""
    who, head = F.lower(F.coalesce(col(author), F.lit(""))), F.lower(F.coalesce(F.substring(col(text), 1, 500), F.lit("")))
    return _holds(who, names) | _holds(head, names) | ((who == "") & _holds(head, OWN_VOICE))


def folder_authority(kind: Column | str, editorial: Column, own: Column, name: Column | str) -> Column:
    """A prior from 0.1 to 1 by folder; newsletters need an editorial and posts the own voice for the higher value."""
    k = col(kind)
    base = F.when(k == "pdfs", 1.0).when(k == "transcripts", 0.95)
    base = base.when(k == "the_batch", F.when(editorial, 0.8).otherwise(0.6)).when(k == "blog_posts", F.when(F.coalesce(own, F.lit(True)), 0.75).otherwise(0.35)).otherwise(0.5)
    return F.round(F.greatest(F.lit(0.1), F.least(base - F.when(_holds(F.lower(col(name)), LESSER_FILES), 0.2).otherwise(0.0), F.lit(1.0))), 9)


def editorial(text: Column | str) -> Column:
    """The letter from its salutation to the next heading or capitalised section; empty if there is none."""
    found = F.regexp_extract(col(text), r"(?s)(Dear [Ff]riends.*?)(?=\n##|\n\n[A-Z][A-Z]|\Z)", 1)
    return F.regexp_replace(F.coalesce(found, F.lit("")), r"^\s+|\s+$", "")


def with_metadata(rows: DataFrame, domain: str | None = None, doc_type: str | None = None, canonical_only: bool = False) -> DataFrame:
    """Rows that meet all the conditions given; without any, all rows."""
    out = rows.where(F.col("domain") == domain) if domain else rows
    out = out.where(F.col("doc_type") == doc_type) if doc_type else out
    return out.where("canonical") if canonical_only else out


def structured(files: DataFrame, name: str = "name", hints: list[str] | None = None) -> DataFrame:
    """Files whose name holds a hint; all files if none does. The one row broadcast says whether any does."""
    hit = F.coalesce(_holds(F.lower(F.col(name)), STRUCTURED_HINTS if hints is None else hints), F.lit(False))
    some = files.where(hit).select(F.lit(1).alias("_one")).limit(1).agg((F.count("*") > 0).alias("_some"))
    return files.join(F.broadcast(some)).where(hit | ~F.col("_some")).drop("_some")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int, preferred: Column) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key, from the preferred rows if there are as many, else from all."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    enough = rows.where(preferred).select(F.lit(1).alias("_one")).limit(n).agg((F.count("*") >= n).alias("_enough"))
    return rows.join(F.broadcast(enough)).where(F.coalesce(preferred, F.lit(False)) | ~F.col("_enough")).drop("_enough").orderBy(place, key).limit(n)
