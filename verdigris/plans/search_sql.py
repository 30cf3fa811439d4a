"""SQL of stems and cover density, for the queries that read the text index."""

from __future__ import annotations

from verdigris.functions.stems import DOUBLE, IRREGULAR, KEPT, REGION, SHORT, STEP_2, STEP_3, STEP_4, STOP_WORDS, UNCHANGED


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


STOP = quoted(STOP_WORDS)
WORDS = r"list_filter(string_split_regex(lower(COALESCE({}, '')), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def _when(table: dict[str, str]) -> str:
    return " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items())


def stem_ctes(source: str) -> str:
    """CTEs that end in ``stems`` (word, stem) for the words of the CTE ``source``."""
    prefix, special = "^(?:gener|commun|arsen)", quoted([*IRREGULAR, *UNCHANGED])
    cut = "left(w, length(w) - length(suf))"
    return f"""
p0 AS (SELECT DISTINCT word FROM {source}),
p1 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM p0 WHERE length(word) > 2 AND word NOT IN ({special})),
p2 AS (SELECT *, CASE WHEN regexp_matches(w, '{prefix}') THEN length(regexp_extract(w, '{prefix}')) WHEN regexp_matches(w, '{REGION}') THEN length(regexp_extract(w, '{REGION}')) ELSE length(w) END AS r1 FROM p1),
p3 AS (SELECT *, CASE WHEN regexp_matches(substr(w, r1 + 1), '{REGION}') THEN r1 + length(regexp_extract(substr(w, r1 + 1), '{REGION}')) ELSE length(w) END AS r2 FROM p2),
p4 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN regexp_matches(w, '(?:us|ss)$') THEN w
  WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM p3),
p5 AS (SELECT *, w IN ({quoted(KEPT)}) AS done, regexp_extract(w, '(?:eedly|ingly|edly|eed|ing|ed)$') AS suf FROM p4),
p6 AS (SELECT *, {cut} AS front FROM p5),
p7 AS (SELECT word, r1, r2, done, CASE WHEN done OR suf = '' THEN w WHEN suf LIKE 'eed%' THEN CASE WHEN length(front) >= r1 THEN front || 'ee' ELSE w END WHEN NOT regexp_matches(front, '[aeiouy]') THEN w
  WHEN regexp_matches(front, '(?:at|bl|iz)$') THEN front || 'e' WHEN regexp_matches(front, '{DOUBLE}') THEN left(front, length(front) - 1) WHEN r1 >= length(front) AND regexp_matches(front, '{SHORT}') THEN front || 'e' ELSE front END AS w FROM p6),
p8 AS (SELECT word, r1, r2, done, CASE WHEN NOT done AND regexp_matches(w, '.[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM p7),
p9 AS (SELECT *, regexp_extract(w, '(?:{"|".join(STEP_2)})$') AS suf FROM p8),
p10 AS (SELECT word, r1, r2, done, CASE WHEN done OR suf = '' OR length({cut}) < r1 OR (suf = 'ogi' AND {cut} NOT LIKE '%l') OR (suf = 'li' AND NOT regexp_matches({cut}, '[cdeghkmnrt]$')) THEN w ELSE {cut} || CASE suf {_when(STEP_2)} END END AS w FROM p9),
p11 AS (SELECT *, regexp_extract(w, '(?:{"|".join(STEP_3)})$') AS suf FROM p10),
p12 AS (SELECT word, r1, r2, done, CASE WHEN done OR suf = '' OR length({cut}) < CASE WHEN suf = 'ative' THEN r2 ELSE r1 END THEN w ELSE {cut} || CASE suf {_when(STEP_3)} END END AS w FROM p11),
p13 AS (SELECT *, regexp_extract(w, '(?:{"|".join(STEP_4)})$') AS suf FROM p12),
p14 AS (SELECT word, r1, r2, done, CASE WHEN done OR suf = '' OR length({cut}) < r2 OR (suf = 'ion' AND NOT regexp_matches({cut}, '[st]$')) THEN w ELSE {cut} END AS w FROM p13),
p15 AS (SELECT word, done, CASE WHEN done THEN w WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1 AND NOT regexp_matches(left(w, length(w) - 1), '{SHORT}'))) THEN left(w, length(w) - 1)
  WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM p14),
stems AS (SELECT word, CASE WHEN done THEN w ELSE replace(w, 'Y', 'y') END AS stem FROM p15 UNION ALL SELECT word, CASE word {_when(IRREGULAR)} ELSE word END FROM p0 WHERE length(word) <= 2 OR word IN ({special}))"""


def text_ctes(first: str, second: str, table: str, key: str, label: str = "B", asked: str = "asked") -> str:
    """CTEs for two fields of a table, the first labelled A: ``toks`` (id, pos, word, weight), and ``stems`` of all words, the queries' too."""
    return f"""
split AS (SELECT {key} AS id, {WORDS.format(first)} AS a, {WORDS.format(second)} AS b FROM {table}),
toks AS (SELECT id, unnest(a) AS word, generate_subscripts(a, 1) AS pos, 1.0::DOUBLE AS weight FROM split UNION ALL
  SELECT id, unnest(b) AS word, generate_subscripts(b, 1) + COALESCE(list_max(list_transform(a, lambda w, i: CASE WHEN w IN ({STOP}) THEN 0 ELSE i END)), 0) AS pos, {dict(A=1.0, B=0.4, C=0.2, D=0.1)[label]}::DOUBLE AS weight FROM split),
qwords AS (SELECT DISTINCT query_id, unnest({WORDS.format("qtext")}) AS word FROM {asked}),
all_words AS (SELECT word FROM toks UNION SELECT word FROM qwords), {stem_ctes("all_words")}"""


def ranked_ctes(k: int = 40, p: str = "lex_", asked: str = "asked", out: str = "lex") -> str:
    """CTEs that end in ``out`` (query_id, id, score, rank): the documents of best cover density; ``p`` begins the other names."""
    return f"""
{p}terms AS (SELECT *, COUNT(*) OVER (PARTITION BY query_id) AS n_terms FROM (SELECT DISTINCT query_id, stem FROM (SELECT DISTINCT query_id, unnest({WORDS.format("qtext")}) AS word FROM {asked}) JOIN stems USING (word) WHERE word NOT IN ({STOP}))),
{p}hits AS (SELECT query_id, id, stem, pos, weight, n_terms FROM toks JOIN stems USING (word) JOIN {p}terms USING (stem)),
{p}every AS (SELECT query_id, id FROM {p}hits GROUP BY query_id, id, n_terms HAVING COUNT(DISTINCT stem) = n_terms),
{p}line AS (SELECT *, row_number() OVER o AS n, SUM(1 / weight) OVER (o ROWS UNBOUNDED PRECEDING) AS inverse FROM {p}hits JOIN {p}every USING (query_id, id) WINDOW o AS (PARTITION BY query_id, id ORDER BY pos)),
{p}each AS (SELECT l.query_id, id, n, t.n_terms, MAX(CASE WHEN l.stem = t.stem THEN n END) OVER (PARTITION BY l.query_id, id, t.stem ORDER BY n) AS last_ FROM {p}line l JOIN {p}terms t ON t.query_id = l.query_id),
{p}ends AS (SELECT query_id, id, n, MIN(last_) AS start FROM {p}each GROUP BY query_id, id, n, n_terms HAVING COUNT(last_) = n_terms),
{p}covers AS (SELECT * FROM {p}ends QUALIFY start > COALESCE(lag(start) OVER (PARTITION BY query_id, id ORDER BY n), 0)),
{p}sums AS (SELECT c.query_id, c.id, SUM((c.n - start + 1) / (e.inverse - b.inverse + 1 / b.weight) / (1 + (e.pos - b.pos) - (c.n - start))) AS s FROM {p}covers c JOIN {p}line e ON e.query_id = c.query_id AND e.id = c.id AND e.n = c.n JOIN {p}line b ON b.query_id = c.query_id AND b.id = c.id AND b.n = start GROUP BY c.query_id, c.id),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id, round(s / (s + 1), 9) AS score FROM {p}sums) QUALIFY rank <= {k})"""
