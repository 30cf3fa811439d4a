"""Classification, source, isolation and evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import corpus, rules
from verdigris.operators import sessions, tables
from verdigris.operators.lineage import step_path
from verdigris.plans.registry import query
from verdigris.plans.text_queries import BROKEN_SQL, TURNS_SQL, turns
from verdigris.sources.records import json_documents, json_lines
from verdigris.sources.tables import table

FOLDERS = ["transcripts", "the_batch", "blog_posts", "pdfs", "books"]
NAMES = ["notes", "working-ai", "hodl", "essay"]
ADDED = ["", " A Lego  brick falls.", " This is Gradient\nDescent.", " non-cat", " legomania", " Don't worry"]

FILES_SQL = f"""files AS (SELECT doc_id, '/corpus/' || {FOLDERS}[1 + doc_id % 5] || '/' || {NAMES}[1 + doc_id % 4] || '-' || doc_id || '.txt' AS path, {FOLDERS}[1 + doc_id % 5] AS kind, {NAMES}[1 + doc_id % 4] || '-' || doc_id || '.txt' AS name,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS author, CASE WHEN doc_id % 7 = 0 THEN 'Dear friends, ' ELSE '' END || text || CASE doc_id % 6 {" ".join(f"WHEN {i} THEN '" + a.replace("'", "''") + "'" for i, a in enumerate(ADDED))} END AS text FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of five folders, some with a salutation and some with a canonical example added."""
    i = F.col("doc_id")
    kind, name = F.element_at(F.lit(FOLDERS), (i % 5 + 1).cast("int")), F.concat(F.element_at(F.lit(NAMES), (i % 4 + 1).cast("int")), F.lit("-"), i, F.lit(".txt"))
    text = F.concat(F.when(i % 7 == 0, "Dear friends, ").otherwise(""), "text", F.element_at(F.lit(ADDED), (i % 6 + 1).cast("int")))
    rows = table(spark, sf_dir, "documents").select("doc_id", kind.alias("kind"), name.alias("name"), F.when(i % 3 == 0, "").otherwise(F.col("source")).alias("author"), text.alias("text"))
    return rows.withColumn("path", F.concat(F.lit("/corpus/"), "kind", F.lit("/"), "name"))


CANONICAL_SQL = "(?i)" + "|".join(corpus.CANONICAL).replace("'", "''")
OWN_SQL = "contains(lower(author), 'source1') OR contains(lower(text[1:500]), 'source1') OR contains(lower(author), 'licen') OR contains(lower(text[1:500]), 'licen') OR (author = '' AND (contains(lower(text[1:500]), 'i think') OR contains(lower(text[1:500]), 'i find') OR contains(lower(text[1:500]), 'dear friends')))"


@query(
    f"""WITH {FILES_SQL}, own AS (SELECT *, COALESCE({OWN_SQL}, false) AS own FROM files)
    SELECT doc_id, CASE kind WHEN 'transcripts' THEN 'transcripts' WHEN 'the_batch' THEN 'newsletter' WHEN 'blog_posts' THEN 'blog_posts' ELSE 'lecture' END AS source_type, CASE kind WHEN 'transcripts' THEN 'spoken' WHEN 'the_batch' THEN 'newsletter' WHEN 'blog_posts' THEN 'blog' ELSE 'written' END AS corpus_kind,
    COALESCE(regexp_matches(text, '{CANONICAL_SQL}'), false) AS canonical, own,
    round(CASE kind WHEN 'pdfs' THEN 1.0::DOUBLE WHEN 'transcripts' THEN 0.95::DOUBLE WHEN 'the_batch' THEN CASE WHEN COALESCE(starts_with(text, 'Dear friends'), false) THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END WHEN 'blog_posts' THEN CASE WHEN own THEN 0.75::DOUBLE ELSE 0.35::DOUBLE END ELSE 0.5::DOUBLE END
      - CASE WHEN starts_with(name, 'working-ai') OR starts_with(name, 'hodl') THEN 0.2::DOUBLE ELSE 0 END, 9) AS authority FROM own"""
)
def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source type, corpus kind, canonical flag, own voice and authority of every file."""
    rows = files(spark, sf_dir).withColumn("own", corpus.own_text("author", "text", ["source1", "licen"]))
    return rows.select(
        "doc_id", corpus.source_type("path").alias("source_type"), corpus.corpus_kind("path").alias("corpus_kind"), corpus.canonical("text").alias("canonical"), "own",
        corpus.folder_authority("kind", F.coalesce(F.col("text").startswith("Dear friends"), F.lit(False)), F.col("own"), "name").alias("authority"),
    )


@query(f"WITH {FILES_SQL} SELECT doc_id FROM files WHERE kind = 'pdfs' AND doc_id % 2 = 0 AND regexp_matches(text, '{CANONICAL_SQL}')")
def filtered_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by domain, folder and canonical flag at once."""
    rows = files(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("domain"), F.col("kind").alias("doc_type"), corpus.canonical("text").alias("canonical"))
    return corpus.with_metadata(rows, "even", "pdfs", True).select("doc_id")


@query(f"WITH {FILES_SQL} SELECT 'hinted' AS choice, doc_id FROM files WHERE contains(name, 'notes') UNION ALL SELECT 'all', doc_id FROM files")
def structured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with a hint in the name, and what is left to choose from when no name has one."""
    rows = files(spark, sf_dir).select("doc_id", "name")
    hinted, every = corpus.structured(rows), corpus.structured(rows, hints=["no such name"])
    return hinted.select(F.lit("hinted").alias("choice"), "doc_id").unionByName(every.select(F.lit("all").alias("choice"), "doc_id"))


LETTERS_SQL = "letters AS (SELECT doc_id, 'Intro' || chr(10) || CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'Dear ' || CASE WHEN doc_id % 2 = 0 THEN 'friends' ELSE 'Friends' END || ', ' END || text || CASE doc_id % 3 WHEN 0 THEN chr(10) || '## News' WHEN 1 THEN chr(10) || chr(10) || 'NEWS of the day' ELSE '' END || ' end' AS page FROM documents)"


@query(
    rf"""WITH {LETTERS_SQL}, cut AS (SELECT doc_id, string_split_regex(CASE WHEN regexp_matches(page, 'Dear [Ff]riends') THEN substr(page, least(CASE WHEN strpos(page, 'Dear friends') = 0 THEN 1000000000 ELSE strpos(page, 'Dear friends') END, CASE WHEN strpos(page, 'Dear Friends') = 0 THEN 1000000000 ELSE strpos(page, 'Dear Friends') END)) ELSE '' END, '\n##|\n\n[A-Z][A-Z]')[1] AS letter FROM letters)
    SELECT doc_id, md5(COALESCE(regexp_replace(letter, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g'), '')) AS digest, COALESCE(length(regexp_replace(letter, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g')), 0) AS size FROM cut"""
)
def editorial_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letter within each page."""
    i = F.col("doc_id")
    head = F.when(i % 4 == 0, "").otherwise(F.concat(F.lit("Dear "), F.when(i % 2 == 0, "friends").otherwise("Friends"), F.lit(", ")))
    tail = F.when(i % 3 == 0, "\n## News").when(i % 3 == 1, "\n\nNEWS of the day").otherwise("")
    page = F.concat(F.lit("Intro\n"), head, "text", tail, F.lit(" end"))
    return table(spark, sf_dir, "documents").select("doc_id", corpus.editorial(page).alias("letter")).select("doc_id", F.md5(F.col("letter").cast("binary")).alias("digest"), F.length("letter").alias("size"))


@query("SELECT doc_id FROM documents WHERE length(text) > 200 ORDER BY md5('7:' || doc_id), doc_id LIMIT 25")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 documents by a seeded hash, from the longer ones."""
    return corpus.seeded_sample(table(spark, sf_dir, "documents"), "doc_id", 25, 7, F.length("text") > 200).select("doc_id")


@query("SELECT item_id, text AS question, item_id % 3 <> 0 AS answerable, CASE WHEN item_id % 3 <> 0 THEN 'f' || item_id END AS source_file, CASE WHEN item_id % 3 <> 0 THEN ['a', text[1:5]] ELSE [] END AS heading_trail FROM benchmark")
def json_lines_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A golden set written as JSONL and scanned by its schema."""
    yes = F.col("item_id") % 3 != 0
    trail = F.when(yes, F.array(F.lit("a"), F.substring("text", 1, 5))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), yes.alias("answerable"), F.when(yes, F.concat(F.lit("f"), "item_id")).alias("source_file"), trail.alias("heading_trail"))
    path = step_path(spark)
    rows.write.json(path)
    return json_lines(spark, path, "item_id long, question string, answerable boolean, source_file string, heading_trail array<string>")


@query("SELECT n_name AS concept, r_name AS region, n_nationkey AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions written as one nested JSON document each and loaded again."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    nested = n.join(r, n.n_regionkey == r.r_regionkey).groupBy("r_name").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("nations"))
    path = step_path(spark)
    pretty = nested.select("r_name", F.to_json(F.struct(F.col("r_name").alias("region"), "nations"), {"pretty": "true"}).alias("value"))
    pretty.write.partitionBy("r_name").text(path)  # a file for each region
    doc = json_documents(spark, f"{path}/*", "region string, nations array<struct<n_name:string,n_nationkey:int>>")
    return doc.select("region", F.explode("nations").alias("n")).select(F.col("n.n_name").alias("concept"), "region", F.col("n.n_nationkey").alias("place"))


@query(f"WITH {TURNS_SQL} SELECT 'own' AS reader, session, COUNT(*) AS n FROM turns WHERE session % 10 = 3 GROUP BY session")
def isolated_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tenant 3 may read and write of the turns, and what nobody may (no rows)."""
    rows = turns(spark, sf_dir).withColumn("tenant", F.col("session") % 10)
    own, none = tables.checked(tables.isolated(rows, 3), 3), tables.isolated(rows, None)
    return own.select(F.lit("own").alias("reader"), "session").unionByName(none.select(F.lit("none").alias("reader"), "session")).groupBy("reader", "session").agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL} SELECT session, COUNT(*) AS n_turns, COUNT(*) FILTER (role = 'user') AS n_user, COUNT(*) FILTER (role = 'user' AND (session + turn) % 3 = 0) AS n_extracted, COUNT(*) FILTER (role = 'user' AND (session + turn) % 3 <> 0) AS n_pending FROM turns GROUP BY session")
def extraction_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return sessions.extraction_status(t, t.where("(session + turn) % 3 = 0").select("session", "turn"))


@query(f"WITH {TURNS_SQL} SELECT session, turn, 'studied' AS p FROM turns WHERE role = 'user' AND session % 4 <> 0")
def guarded_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations from user turns, after every fourth session was deleted."""
    t = turns(spark, sf_dir).withColumn("tenant", F.lit(0))
    ops = t.where("role = 'user'").select("tenant", "session", "turn", F.lit("studied").alias("p"))
    return tables.from_live_turns(ops, t.where("session % 4 <> 0")).drop("tenant")


PLANTED = ["", "\n# Heading\nmore.", "\n- one\n- two.", "\n1. first.", "\nTakeaway: all.", " and so on", " Does that make sense?"]
PLANTED_SQL = f"turns AS (SELECT conv_id AS session, turn, role, CASE WHEN (conv_id + turn) % 8 = 7 THEN 'Great question! ' ELSE '' END || text || CASE (conv_id + turn) % 7 {' '.join(f'WHEN {i} THEN ' + chr(39) + a + chr(39) for i, a in enumerate(PLANTED))} END AS text FROM conversations WHERE role <> 'system')"


@query(f"WITH {PLANTED_SQL}, {BROKEN_SQL} SELECT rule, COUNT(*) AS n, COUNT(DISTINCT (session, turn)) AS answers FROM broken GROUP BY rule")
def planted_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with broken rules added, counted by rule."""
    at = F.col("session") + F.col("turn")
    text = F.concat(F.when(at % 8 == 7, "Great question! ").otherwise(""), "text", F.element_at(F.lit(PLANTED), (at % 7 + 1).cast("int")))
    found = turns(spark, sf_dir).where("role = 'assistant'").select("session", "turn", F.explode(rules.violations(text)).alias("v"))
    return found.groupBy(F.col("v.rule").alias("rule")).agg(F.count("*").alias("n"), F.count_distinct("session", "turn").alias("answers"))
