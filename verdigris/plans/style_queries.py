"""Cleaning, header and style queries over documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import text
from verdigris.operators import style
from verdigris.plans.registry import query
from verdigris.plans.text_queries import SENTENCES_SQL
from verdigris.sources import html
from verdigris.sources.tables import table

KINDS = ["pdf", "transcript", "newsletter"]
WHITE = "[ \\t\\n\\r\\f\\v]+"


def _sub(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def _clean_sql() -> str:
    """CTEs that end in ``clean`` (doc_id, text, kind, clean): the cleaning of the three kinds as nested SQL."""
    plain = "translate(text, '‘’“” ﻿​‎‏', '''''\"\" ')"
    furniture = " OR ".join(f"regexp_matches(trim(l), '{p}')" for p in text.PAGE_FURNITURE)
    marked = f"array_to_string(list_filter(string_split(base, chr(10)), lambda l: NOT ({furniture})), chr(10))"
    for name, char in text.LATEX:
        marked = _sub(marked, f"\\\\{name}", char.replace("$1", "\\1"))
    for name in ("text", "mathrm", "mathbf"):
        marked = _sub(marked, f"\\\\{name}\\{{([^}}]+)\\}}", "\\1")
    for name in ("begin", "end"):
        marked = _sub(marked, f"\\\\{name}\\{{[^}}]+\\}}", "")
    marked = _sub(marked, "\\\\[a-zA-Z]+(?:\\{[^}]*\\})?", "")
    spoken = _sub("base", "[\\[(]\\d{1,2}:\\d{2}(?::\\d{2})?[\\])]", "")
    spoken = _sub(spoken, "(?m)^\\d{1,2}:\\d{2}(?::\\d{2})?\\s*$", "")
    for filler in text.FILLERS:
        spoken = _sub(spoken, f"(?i){filler}", "")
    spoken = f"array_to_string(list_transform(string_split({spoken}, chr(10)), lambda l: trim(l)), chr(10))"
    for _ in range(2):  # a match takes the letters on both sides, so lines of one letter need a second pass
        spoken = _sub(spoken, "([^.!?:\\n])\\n(\\p{Ll})", "\\1 \\2")
    tidy = _sub(_sub("mid", "\\n{4,}", "\n\n\n"), "[ \\t\\r\\f\\v]+(\\n|$)", "\\1")
    tidy = _sub(_sub(tidy, f"^{WHITE}", ""), f"{WHITE}$", "") + " || chr(10)"
    return f"""based AS (SELECT doc_id, text, ['pdf', 'transcript', 'newsletter'][doc_id % 3 + 1] AS kind, replace({plain}, '…', '...') AS base FROM documents),
    turned AS (SELECT doc_id, text, kind, CASE kind WHEN 'pdf' THEN {marked} WHEN 'transcript' THEN {spoken} ELSE base END AS mid FROM based), clean AS (SELECT doc_id, text, kind, {tidy} AS clean FROM turned)"""


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.lit(KINDS), (F.col("doc_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), "text", text.clean_document("text", kind).alias("clean"))


@query(f"WITH {_clean_sql()} SELECT doc_id, kind, md5(clean) AS digest FROM clean")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cleaned by its kind, as a digest."""
    return _cleaned(spark, sf_dir).select("doc_id", "kind", F.md5(F.col("clean").cast("binary")).alias("digest"))


@query(
    f"""WITH {_clean_sql()}, counted AS (SELECT kind, len(regexp_extract_all(text, '[A-Za-z'']+')) AS a, len(regexp_extract_all(clean, '[A-Za-z'']+')) AS b FROM clean)
    SELECT kind, COUNT(*) AS files, SUM(a)::BIGINT AS words, SUM(a - b)::BIGINT AS removed, round(100.0::DOUBLE * SUM(a - b) / SUM(a), 1) AS reduction FROM counted GROUP BY kind"""
)
def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full cleaning by kind with what it took away."""
    before, after = text.word_count("text"), text.word_count("clean")
    return _cleaned(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("files"), F.sum(before).alias("words"), F.sum(before - after).alias("removed"), F.round(100.0 * F.sum(before - after) / F.sum(before), 1).alias("reduction"))


TRIMMED = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
RULED_SQL = rf"""made AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '# Title: T ' || doc_id || chr(10) || '# Date:  2024-01-' || (10 + doc_id % 19) || ' ' || chr(10) || chr(10) || '============' || chr(10) || '# Title: inside' || chr(10) || text WHEN 1 THEN '# URL: u' || doc_id || chr(10) || '#other' || chr(10) || text
    WHEN 2 THEN '# Domain: d' || chr(10) || '# Domain: e' || doc_id || chr(10) || '  ' ELSE text END AS content FROM documents),
    cut AS (SELECT doc_id, string_split_regex(content, '\r\n|[\n\r\x0B\f\x1C-\x1E\x{{85}}\x{{2028}}\x{{2029}}]') AS lines FROM made),
    opened AS (SELECT doc_id, lines, list_filter(list_transform(lines, lambda l, i: CASE WHEN regexp_matches(l, '^(?:={{10}}|-{{10}})') THEN [i - 1, i] WHEN NOT starts_with(l, '#') AND {TRIMMED.format("l")} <> '' THEN [i - 1, i - 1] END), lambda p: p IS NOT NULL)[1] AS o FROM cut),
    parts AS (SELECT doc_id, lines, CASE WHEN o IS NULL THEN lines ELSE lines[1:o[1]] END AS head, COALESCE(o[2], 0) AS body FROM opened)"""


def _head_sql(name: str) -> str:
    return TRIMMED.format(f"replace(list_filter(head, lambda l: starts_with(l, '# {name}:'))[-1], '# {name}:', '')") + f" AS {name.lower()}"


@query(f"WITH {RULED_SQL} SELECT doc_id, {', '.join(_head_sql(n) for n in ('Title', 'URL', 'Date', 'Domain'))}, md5({TRIMMED.format('array_to_string(lines[body + 1:], chr(10))')}) AS body FROM parts")
def header_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under headers of four kinds: what the headers say, and the body as a digest."""
    i = F.col("doc_id")
    content = (
        F.when(i % 4 == 0, F.concat(F.lit("# Title: T "), i, F.lit("\n# Date:  2024-01-"), 10 + i % 19, F.lit(" \n\n============\n# Title: inside\n"), "text"))
        .when(i % 4 == 1, F.concat(F.lit("# URL: u"), i, F.lit("\n#other\n"), "text"))
        .when(i % 4 == 2, F.concat(F.lit("# Domain: d\n# Domain: e"), i, F.lit("\n  ")))
        .otherwise(F.col("text"))
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))
    told = rows.select("doc_id", html.headers("content", ["Title", "URL", "Date", "Domain"]).alias("h"), html.body_after_headers("content").alias("body"))
    return told.select("doc_id", *(F.col("h")[n].alias(n) for n in ("title", "url", "date", "domain")), F.md5(F.col("body").cast("binary")).alias("body"))


STYLED = {"pronouns": ["i", "you", "we"], "connectives": ["so", "and the", "but"], "hedges": ["may", "in the", "or"], "probes": ["th", "on the"]}


def _rate_sql(phrase: str, digits: int | None = None) -> str:
    rate = f"CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all(t, '\\b{phrase.replace(' ', WHITE)}')) * 1000.0::DOUBLE / len(w) END"
    return rate if digits is None else f"round({rate}, {digits})"


def _own_sql(pronoun: str) -> str:
    return f"round(1000.0::DOUBLE * len(list_filter(w, lambda x: x = '{pronoun}')) / GREATEST(len(w), 1), 2) AS pronoun_{pronoun}_per_1k"


@query(
    f"""WITH {SENTENCES_SQL}, w AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[a-z'']+') AS w, lower(COALESCE(text, '')) AS t, len(list_filter(string_split(regexp_replace(COALESCE(text, ''), '([.!?]){WHITE}', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '{WHITE}', '', 'g') <> '')) AS sentences FROM documents)
    SELECT w.doc_id, len(w) AS words, w.sentences, COALESCE(mean_len, 0.0::DOUBLE) AS mean_len, COALESCE(median_len, 0.0::DOUBLE) AS median_len, COALESCE(p90_len, 0.0::DOUBLE) AS p90_len, {', '.join(_own_sql(p) for p in STYLED['pronouns'])},
    {', '.join(f'{_rate_sql(p, 3)} AS connective_{n}' for n, p in enumerate(STYLED['connectives']))}, round({' + '.join(_rate_sql(p) for p in STYLED['hedges'])}, 3) AS hedges_per_1k, {', '.join(f'{_rate_sql(p, 4)} AS probe_{n}' for n, p in enumerate(STYLED['probes']))} FROM w LEFT JOIN spread s ON s.doc_id = w.doc_id"""
)
def style_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All style statistics of every document in one row."""
    rows = style.analyse(table(spark, sf_dir, "documents"), "doc_id", **STYLED)

    def each(name: str, one: str) -> list[Column]:
        return [F.col(name)[p].alias(f"{one}_{n}") for n, p in enumerate(STYLED[name])]

    return rows.select("*", *each("connectives", "connective"), *each("probes", "probe")).drop("connectives", "probes")
