"""Session, cleaning, style, rule, entity and load queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions import rules, text
from verdigris.operators import entities, sessions, style, tables
from verdigris.plans.registry import query
from verdigris.sources.tables import table

TURNS_SQL = "turns AS (SELECT conv_id AS session, turn, role, text FROM conversations WHERE role <> 'system')"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("session"), "turn", "role", "text")


@query(f"WITH {TURNS_SQL} SELECT session, COUNT(*) AS n_messages, MIN(turn) AS first_turn, MAX(turn) AS last_turn, left(regexp_replace(arg_min(text, turn) FILTER (role = 'user'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), 60) AS title FROM turns GROUP BY session")
def session_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summaries(turns(spark, sf_dir))


@query(f"WITH {TURNS_SQL} SELECT session, turn, text, (SELECT arg_min(a.text, a.turn) FROM turns a WHERE a.session = u.session AND a.turn > u.turn AND a.role = 'assistant') AS reply FROM turns u WHERE role = 'user'")
def next_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.next_reply(turns(spark, sf_dir))


@query(f"WITH {TURNS_SQL} SELECT session, COUNT(*) AS n, MAX(turn) AS last FROM (SELECT session, turn FROM turns UNION ALL SELECT conv_id, COALESCE((SELECT MAX(turn) + 1 FROM turns t WHERE t.session = conv_id), 0) + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 FROM conversations WHERE role = 'system') GROUP BY session")
def appended_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = table(spark, sf_dir, "conversations").where("role = 'system'").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.lit("assistant").alias("role"), "text")
    return sessions.append_turns(turns(spark, sf_dir), fresh).groupBy("session").agg(F.count("*").alias("n"), F.max("turn").alias("last"))


@query("SELECT conv_id AS session, CASE WHEN r > 1 THEN t + 10000 + r ELSE t END AS turn, text FROM (SELECT conv_id, turn // 2 AS t, text, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn, role, text) AS r FROM conversations)")
def renumbered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.expr("turn div 2").alias("turn"), F.col("turn").alias("old"), "role", "text")
    return sessions.renumber(rows, ["old", "role", "text"]).select("session", "turn", "text")


@query(
    f"""WITH {TURNS_SQL}, last AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS n FROM turns QUALIFY n <= 6), marked AS (SELECT *, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS new FROM last WINDOW w AS (PARTITION BY session ORDER BY turn)),
    runs AS (SELECT *, SUM(new) OVER (PARTITION BY session ORDER BY turn) AS run FROM marked) SELECT session, MIN(turn) AS first_turn, any_value(role) AS role, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM runs GROUP BY session, run"""
)
def history_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.history(turns(spark, sf_dir))


@query(f"WITH {TURNS_SQL} SELECT session, string_agg(role || ': ' || left(text, 220), chr(10) ORDER BY turn) AS memory FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS n FROM turns) WHERE n <= 8 GROUP BY session")
def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.memory_text(turns(spark, sf_dir))


@query(f"WITH {TURNS_SQL} SELECT session, turn FROM (SELECT session, turn, row_number() OVER (PARTITION BY session ORDER BY turn DESC) AS n FROM turns WHERE role = 'user' AND (session + turn) % 3 <> 0) WHERE n <= 3")
def pending_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return sessions.pending(t, t.where("(session + turn) % 3 = 0").select("session", "turn"))


@query(f"WITH {TURNS_SQL} SELECT session, COUNT(*) AS n FROM turns WHERE session % 4 <> 0 GROUP BY session")
def kept_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return sessions.without_sessions(t, t.where("session % 4 = 0").select("session").distinct()).groupBy("session").agg(F.count("*").alias("n"))


GREETING = rules.GREETING.replace("'", "''")
OPINION, CONCEPT, BACKREF = (x.replace("'", "''") for x in (rules.OPINION, rules.CONCEPT, rules.BACKREF))
WORDS = "len(regexp_extract_all(text, '[A-Za-z'']+'))"


@query(
    f"""WITH {TURNS_SQL} SELECT session, turn, CASE WHEN trim(text) = '' OR regexp_matches(trim(text), '{GREETING}') THEN 'greeting' WHEN regexp_matches(trim(text), '{OPINION}') THEN 'opinion' WHEN regexp_matches(trim(text), '{CONCEPT}') OR {WORDS} > 12 THEN 'concept' WHEN turn > 1 THEN 'followup' ELSE 'concept' END AS kind,
    CASE WHEN turn <= 1 OR {WORDS} = 0 THEN false ELSE {WORDS} <= 4 OR ({WORDS} <= 18 AND regexp_matches(text, '{BACKREF}')) OR (lower(regexp_extract(text, '[A-Za-z'']+')) IN ({", ".join(f"'{w}'" for w in rules.OPENERS)}) AND {WORDS} <= 6) END AS rewrite FROM turns WHERE role = 'user'"""
)
def routed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir).where("role = 'user'")
    plan = rules.classify_turn("text", F.col("turn") > 1)
    return t.select("session", "turn", plan["kind"].alias("kind"), rules.needs_rewrite("text", F.col("turn") > 1).alias("rewrite"))


PHRASES_SQL = ", ".join("'" + p.replace("'", "''") + "'" for p in rules.PHRASES)
BROKEN_SQL = f"""broken AS (
  SELECT session, turn, 'banned_phrase' AS rule FROM turns, (SELECT unnest([{PHRASES_SQL}]) AS p) WHERE role = 'assistant' AND contains(lower(trim(text)), p)
  UNION ALL SELECT session, turn, 'markdown_header' FROM turns WHERE role = 'assistant' AND regexp_matches(trim(text), '{rules.HEADER}')
  UNION ALL SELECT session, turn, 'bullet_list' FROM turns WHERE role = 'assistant' AND regexp_matches(trim(text), '{rules.BULLET}')
  UNION ALL SELECT session, turn, 'numbered_list' FROM turns WHERE role = 'assistant' AND regexp_matches(trim(text), '{rules.NUMBERED}')
  UNION ALL SELECT session, turn, 'scaffold_label' FROM turns WHERE role = 'assistant' AND regexp_matches(trim(text), '{rules.LABEL}')
  UNION ALL SELECT session, turn, 'unfinished' FROM turns WHERE role = 'assistant' AND right(trim(text), 1) NOT IN ('.', '!', '?', '"', '''', ')', ']', ':')
  UNION ALL SELECT session, turn, 'banned_opener' FROM turns WHERE role = 'assistant' AND len(list_filter([{", ".join("'" + p.replace("'", "''") + "'" for p in rules.PRAISE)}], lambda p: starts_with(ltrim(lower(trim(text)), '"''*_ '), p))) > 0
)"""


@query(f"WITH {TURNS_SQL}, {BROKEN_SQL} SELECT rule, COUNT(*) AS n FROM broken GROUP BY rule")
def violations_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns(spark, sf_dir).where("role = 'assistant'").select(F.explode(rules.violations("text")).alias("v"))
    return found.groupBy(F.col("v.rule").alias("rule")).agg(F.count("*").alias("n"))


@query(f"WITH {TURNS_SQL}, {BROKEN_SQL} SELECT COUNT(*) AS answers, round(AVG(CASE WHEN b.session IS NULL THEN 1.0::DOUBLE ELSE 0 END), 9) AS clean_rate, round(AVG({WORDS}), 9) AS mean_words FROM turns t LEFT JOIN (SELECT DISTINCT session, turn FROM broken) b USING (session, turn) WHERE role = 'assistant'")
def answer_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = turns(spark, sf_dir).where("role = 'assistant'")
    return a.agg(F.count("*").alias("answers"), F.round(F.avg(F.when(F.size(rules.violations("text")) == 0, 1.0).otherwise(0.0)), 9).alias("clean_rate"), F.round(F.avg(text.word_count("text")), 9).alias("mean_words"))


@query()
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).where("role = 'assistant'").select("session", "turn", rules.repair("text").alias("text"))


@query(
    f"""WITH base AS (SELECT conv_id AS session, turn, translate(trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), '<>', '()') AS t FROM conversations)
    SELECT session, turn, CASE WHEN regexp_matches(t, '(?i){rules.INJECTION}') THEN '' WHEN length(t) > 200 THEN rtrim(left(t, 200)) || '...' ELSE t END AS evidence FROM base"""
)
def sanitized_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", rules.sanitize_evidence("text").alias("evidence"))


@query("SELECT doc_id, md5(replace(translate(text, '‘’“” ﻿​‎‏', '''''\"\" '), '…', '...')) AS digest FROM documents")
def normalized_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_encoding("text").cast("binary")).alias("digest"))


@query(
    """SELECT doc_id, md5(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT (regexp_matches(trim(x), '^[0-9]{1,4}$') OR regexp_matches(trim(x), '(?i)^(CS[ \\t]*229|Machine Learning|Andrew Ng|Stanford University)[ \\t]*$') OR regexp_matches(trim(x), '^[_\\-=]{10,}$'))), chr(10))) AS digest FROM documents"""
)
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.drop_page_furniture("text").cast("binary")).alias("digest"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(COALESCE(text, '')), '[a-z'']+') AS w, lower(COALESCE(text, '')) AS t FROM documents)
    SELECT doc_id, len(w) AS words, round(1000.0::DOUBLE * len(list_filter(w, lambda x: x = 'i')) / GREATEST(len(w), 1), 2) AS i_per_1k, round(1000.0::DOUBLE * len(list_filter(w, lambda x: x = 'we')) / GREATEST(len(w), 1), 2) AS we_per_1k,
    CASE WHEN len(w) = 0 THEN 0.0::DOUBLE ELSE round(1000.0::DOUBLE * len(regexp_extract_all(t, '\\bso')) / len(w), 3) END AS so_per_1k FROM w"""
)
def style_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.rates(table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", {"i_per_1k": "i", "we_per_1k": "we"}, {"so_per_1k": "so"})


SENTENCES_SQL = """sentences AS (SELECT doc_id, len(regexp_extract_all(s, '[A-Za-z'']+')) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \\t\\n\\r\\f\\v]+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents)),
sized AS (SELECT doc_id, list(n ORDER BY n) AS ns FROM sentences WHERE n > 0 GROUP BY doc_id),
spread AS (SELECT doc_id, len(ns) AS sentences, round(list_avg(ns), 2) AS mean_len, round(list_median(ns), 2) AS median_len,
  round(CASE WHEN len(ns) > 9 THEN ns[LEAST(GREATEST(9 * (len(ns) + 1) // 10, 1), len(ns) - 1)] + (9 * (len(ns) + 1) - 10 * LEAST(GREATEST(9 * (len(ns) + 1) // 10, 1), len(ns) - 1)) * (ns[LEAST(GREATEST(9 * (len(ns) + 1) // 10, 1), len(ns) - 1) + 1] - ns[LEAST(GREATEST(9 * (len(ns) + 1) // 10, 1), len(ns) - 1)]) / 10.0::DOUBLE ELSE ns[len(ns)]::DOUBLE END, 2) AS p90_len FROM sized)"""


@query(f"WITH {SENTENCES_SQL} SELECT * FROM spread")
def sentence_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.sentence_spread(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {SENTENCES_SQL} SELECT d.source, SUM(sentences) AS sentences, round(SUM(mean_len * sentences) / SUM(sentences), 2) AS mean_len, round(SUM(p90_len * sentences) / SUM(sentences), 2) AS p90_len FROM spread JOIN documents d USING (doc_id) GROUP BY d.source")
def merged_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return style.merge(style.sentence_spread(docs, "doc_id").join(docs.select("doc_id", "source"), "doc_id"), "source", "sentences", ["mean_len", "p90_len"])


@query(
    """SELECT doc_id, CASE WHEN contains(lower(text), 'license') OR contains(lower(text), 'apache') THEN 'legal' WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'scum') THEN 'abuse' WHEN contains(lower(text), '@') THEN 'contact' ELSE 'general' END AS domain FROM documents"""
)
def domain_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = [("legal", ["license", "apache"]), ("abuse", ["idiot", "scum"]), ("contact", ["@"])]
    return table(spark, sf_dir, "documents").select("doc_id", rules.first_match("text", cases, "general").alias("domain"))


@query(
    """WITH grams AS (SELECT p_name, unnest(list_distinct(flatten(list_transform(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))) AS g FROM (SELECT DISTINCT p_name FROM part)),
    sizes AS (SELECT p_name, COUNT(*) AS n FROM grams GROUP BY p_name), shared AS (SELECT a.p_name AS surface, b.p_name AS name, COUNT(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.p_name <> b.p_name GROUP BY 1, 2),
    pairs AS (SELECT surface, name, round(c / (x.n + y.n - c)::DOUBLE, 9) AS similarity FROM shared JOIN sizes x ON x.p_name = surface JOIN sizes y ON y.p_name = name)
    SELECT surface, name, similarity FROM (SELECT *, row_number() OVER (PARTITION BY surface ORDER BY similarity DESC, name) AS n FROM pairs WHERE similarity >= 0.6) WHERE n = 1"""
)
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part name against all other part names."""
    names = table(spark, sf_dir, "part").select("p_name").where("p_name is not null").distinct()
    return entities.fuzzy(names.select(F.col("p_name").alias("surface")), names.select(F.col("p_name").alias("name")), others=True)


@query("SELECT o_orderpriority AS source_file, CASE WHEN old IS NULL THEN 'insert' WHEN old = new THEN 'skip' ELSE 'replace' END AS action FROM (SELECT o_orderpriority, COUNT(*) AS new, SUM(CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' AND o_orderkey % 2 = 0 THEN 1 END) AS old FROM orders GROUP BY 1)")
def load_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    fresh = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source_file"), "o_orderkey")
    stored = fresh.where("source_file like '1%' or source_file like '2%' and o_orderkey % 2 = 0")
    return tables.load_plan(stored, fresh)


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN round(c_acctbal + 1, 2) ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000000, round(c_acctbal + 1, 2) FROM customer WHERE c_custkey % 7 = 0")
def upserted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changed = old.withColumn("c_acctbal", F.round(F.col("c_acctbal") + 1, 2))
    new = changed.where("c_custkey % 5 = 0").unionByName(changed.where("c_custkey % 7 = 0").withColumn("c_custkey", F.col("c_custkey") + 1_000_000_000))
    return tables.upsert(old, new, ["c_custkey"])


@query("SELECT l_partkey % 50 AS prerequisite, l_suppkey % 50 AS concept, MAX(l_quantity) AS confidence, COALESCE(MAX(CASE WHEN l_linenumber > 2 THEN l_shipdate::VARCHAR END), MAX(l_shipdate::VARCHAR)) AS evidence FROM lineitem GROUP BY 1, 2")
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("prerequisite"), (F.col("l_suppkey") % 50).alias("concept"), F.col("l_quantity").alias("confidence"), F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("evidence"), "l_linenumber")
    return tables.merge_edges(rows.where("l_linenumber <= 2").drop("l_linenumber"), rows.where("l_linenumber > 2").drop("l_linenumber"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey * 100000 + l_suppkey) AS n FROM lineitem) WHERE n = 1")
def strongest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.strongest(table(spark, sf_dir, "lineitem").withColumn("seq", F.col("l_partkey") * 100000 + F.col("l_suppkey")), ["l_orderkey"], "l_quantity", "seq").select("l_orderkey", "l_partkey", "l_quantity")


@query("SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', ' ', 'g')) AS concept, substr(sha256(p_name), 1, 16) AS checksum, CASE WHEN length(p_name) > 0 THEN substr(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 80) ELSE '' END AS filename FROM part")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_concept("p_name").alias("concept"), text.checksum16("p_name").alias("checksum"), text.safe_filename("p_name").alias("filename"))


@query("SELECT COALESCE(lang, 'unknown') AS model, COUNT(*) AS n FROM documents GROUP BY 1")
def embedding_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("model")).agg(F.count("*").alias("n"))
