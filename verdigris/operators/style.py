"""Style statistics of texts and their merging over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.text import WORD, phrase_per_1k, rounded, word_count


def rates(docs: DataFrame, key: str, words: dict[str, str], phrases: dict[str, str], text: str = "text") -> DataFrame:
    """(key, words, ...): uses of whole words and of phrase starts, by 1,000 words."""
    n = word_count(text)
    found = F.regexp_extract_all(F.lower(F.col(text)), F.lit("([a-z']+)"), 1)

    def uses(target: str) -> Column:
        return rounded(1000.0 * F.size(F.filter(found, lambda w: w == target)) / F.greatest(n, F.lit(1)), 2)

    own = [uses(target).alias(name) for name, target in words.items()]
    return docs.select(key, n.alias("words"), *own, *[rounded(phrase_per_1k(text, p), 3).alias(name) for name, p in phrases.items()])


def sentence_spread(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sentences, mean_len, median_len, p90_len): words a sentence; the ninth decile by the exclusive method."""
    parts = F.split(F.regexp_replace(F.col(text), "([.!?])[ \\t\\n\\r\\f\\x0B]+", "$1\x01"), "\x01")
    ns = F.array_sort(F.filter(F.transform(parts, lambda s: F.regexp_count(s, F.lit(WORD))), lambda n: n > 0))
    rows = docs.select(key, ns.alias("ns")).where(F.size("ns") > 0).withColumn("n", F.size("ns"))
    j = F.least(F.greatest(F.expr("9 * (n + 1) div 10").cast("int"), F.lit(1)), F.col("n") - 1)
    low, high = F.get("ns", j - 1), F.get("ns", j)
    p90 = F.when(F.col("n") > 9, low + (9 * (F.col("n") + 1) - 10 * j) * (high - low) / F.lit(10.0)).otherwise(F.element_at("ns", -1).cast("double"))
    middle = (F.get("ns", F.expr("(n - 1) div 2").cast("int")) + F.get("ns", F.expr("n div 2").cast("int"))) / F.lit(2.0)
    mean = F.aggregate("ns", F.lit(0), lambda a, b: a + b) / F.col("n")
    return rows.select(key, F.col("n").alias("sentences"), rounded(mean, 2).alias("mean_len"), rounded(middle, 2).alias("median_len"), rounded(p90, 2).alias("p90_len"))


def analyse(docs: DataFrame, key: str, pronouns: list[str], connectives: list[str], hedges: list[str], probes: list[str], text: str = "text") -> DataFrame:
    """All statistics of each text in one row: words, sentences and their lengths, pronouns, connectives, hedges and probes by 1,000 words.

    ``connectives`` and ``probes`` are maps by phrase; hedges are one sum. A text without words has zeros.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, x.alias("_x"))
    n = word_count("_x")
    words = F.regexp_extract_all(F.lower("_x"), F.lit("([a-z']+)"), 1)
    parts = F.split(F.regexp_replace("_x", "([.!?])[ \\t\\n\\r\\f\\x0B]+", "$1\x01"), "\x01")
    blank = F.size(F.filter(parts, lambda p: F.regexp_replace(p, "[ \\t\\n\\r\\f\\x0B]+", "") != ""))
    spread = sentence_spread(rows, key, "_x").drop("sentences")
    def uses(target: str) -> Column:
        return rounded(1000.0 * F.size(F.filter(words, lambda w: w == target)) / F.greatest(n, F.lit(1)), 2).alias(f"pronoun_{target}_per_1k")

    per = [uses(p) for p in pronouns]

    def phrases(which: list[str], digits: int) -> Column:
        return F.create_map(*[v for p in which for v in (F.lit(p), rounded(phrase_per_1k("_x", p), digits))])

    hedged = F.lit(0.0)
    for h in hedges:
        hedged = hedged + phrase_per_1k("_x", h)
    told = rows.select(key, n.alias("words"), blank.alias("sentences"), *per, phrases(connectives, 3).alias("connectives"), rounded(hedged, 3).alias("hedges_per_1k"), phrases(probes, 4).alias("probes"))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean_len", "median_len", "p90_len")]
    return told.join(spread, key, "left").select(key, "words", "sentences", *zero, *[p for p in told.columns if p not in (key, "words", "sentences")])


def merge(stats: DataFrame, by: str, weight: str, means: list[str]) -> DataFrame:
    """Statistics of groups of texts: the total weight, and means weighted by it."""
    return stats.groupBy(by).agg(F.sum(weight).alias(weight), *[rounded(F.sum(F.col(m) * F.col(weight)) / F.sum(weight), 2).alias(m) for m in means])


def distance(sample: DataFrame, base: DataFrame, names: list[str]) -> DataFrame:
    """(name, distance): relative distances of one-row statistics, where the base is large enough to tell."""
    rows = [(n, F.col(f"s.{n}"), F.col(f"b.{n}")) for n in names]
    both = sample.limit(1).alias("s").join(F.broadcast(base.limit(1)).alias("b"))  # one row each
    cases = F.array(*[F.struct(F.lit(n).alias("name"), F.when(b >= 0.1, rounded(F.abs(s - b) / b, 3)).alias("distance")) for n, s, b in rows])
    return both.select(F.explode(cases).alias("c")).select("c.name", "c.distance").where(F.col("distance").isNotNull())
