"""Operator 9: SimHash fingerprints of documents, DataFrame functions only.

A text's terms are its lower-cased 3-word shingles (a shorter text is one term). Each term hash
of 128 bits votes for every bit with the term's weight; a bit is set when the votes for it
outweigh those against. Votes are summed four to a long, 16 bits each, over slices of at most
8,192 terms, then widened, so no text is too long.

Null or word-less texts get the all-zero fingerprint. Equal texts get equal fingerprints.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import id_cuts, range_of

BITS = 128
SLICE = 8192
SPACE = "[\\x20\\x09-\\x0D]+"
_LANES = 0x0001000100010001
_PAIRS = 0x0000FFFF0000FFFF


def _votes(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per ``keys``: ``hi`` and ``lo``, the fingerprint's halves. ``keys`` must name a row of ``rows``."""
    words = rows.select(*keys, F.array_remove(F.split(F.lower(F.col(text)), SPACE), "").alias("_w"))
    terms = words.select(*keys, "_w", F.posexplode("_w").alias("_p", "_a"))
    b, c = F.get("_w", F.col("_p") + 1), F.get("_w", F.col("_p") + 2)
    terms = terms.where(c.isNotNull() | (F.col("_p") == 0)).select(
        *keys,
        F.expr(f"_p div {SLICE}").alias("_s"),
        F.xxhash64("_a", b, c).alias("_h"),
        F.when(F.length("_a") + F.coalesce(F.length(b), F.lit(0)) + F.coalesce(F.length(c), F.lit(0)) >= 12, 2).otherwise(1).cast("long").alias("_n"),
    )
    terms = terms.select(*keys, "_s", "_h", F.xxhash64("_h").alias("_g"), "_n")
    lanes = [(h, i) for h in "hg" for i in range(16)]
    sums = [F.sum(F.col("_n") * F.shiftright(f"_{h}", i).bitwiseAND(F.lit(_LANES))).alias(f"_{h}{i}") for h, i in lanes]
    packed = terms.groupBy(*keys, "_s").agg(F.sum("_n").alias("_t"), *sums)
    wide = [F.sum(F.shiftrightunsigned(f"_{h}{i}", s).bitwiseAND(F.lit(_PAIRS))).alias(f"_{h}{i}_{s}") for h, i in lanes for s in (0, 16)]
    total = packed.groupBy(*keys).agg(F.sum("_t").alias("_t"), *wide)

    def half(h: str) -> Column:
        out = F.lit(0).cast("long")
        for i in range(16):
            for s in (0, 16):
                for up in (0, 32):
                    ones = F.shiftrightunsigned(f"_{h}{i}_{s}", up).bitwiseAND(F.lit(0xFFFFFFFF))
                    bit = i + s + up
                    out = out.bitwiseOR(F.when(ones * 2 > F.col("_t"), F.shiftleft(F.lit(1).cast("long"), bit)).otherwise(F.lit(0).cast("long")))
        return out

    return total.select(*keys, half("h").alias("hi"), half("g").alias("lo"))


def _hex(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits of two fingerprints given as halves."""
    return 1 - (F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))) / F.lit(float(BITS))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hi, lo, fingerprint) of every row; rows that share a key form one text's votes, so keys should be unique."""
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    got = _votes(rows, [key], "_text")
    zero = F.lit(0).cast("long")
    out = rows.select(key).join(got.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left")
    return out.select(key, F.coalesce("hi", zero).alias("hi"), F.coalesce("lo", zero).alias("lo")).withColumn("fingerprint", _hex(F.col("hi"), F.col("lo")))


def hamming_classes(prints: DataFrame) -> DataFrame:
    """(hi, lo, rows, first_id): equal fingerprints as one class, so that copies never meet in a join."""
    return prints.groupBy("hi", "lo").agg(F.count("*").alias("rows"), F.min("doc_id").alias("first_id"))


def within_radius(queries: DataFrame, classes: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query hi, lo; class hi, lo; distance) within ``radius`` bits, itself excluded.

    Permuted block tables: the 128 bits are cut into ``blocks`` blocks; two fingerprints within
    ``radius`` bits agree on at least ``blocks - radius`` of them, so one table for each choice
    of that many blocks finds every pair. Each pair comes from its first table only, so no
    global distinct is needed. Both inputs have one row per distinct fingerprint.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below the number of blocks")
    edges = [BITS * i // blocks for i in range(blocks + 1)]

    def block(i: int) -> Column:
        """Bits edges[i]..edges[i+1] of hi followed by lo, as up to two longs."""
        a, b = edges[i], edges[i + 1]
        parts = []
        for half, low in (("hi", 0), ("lo", 64)):
            x, y = max(a, low) - low, min(b, low + 64) - low
            if x < y:
                parts.append(F.shiftrightunsigned(F.shiftleft(F.col(half), x), 64 - (y - x)))
        return F.struct(*[p.alias(f"p{n}") for n, p in enumerate(parts)])

    tables = list(combinations(range(blocks), blocks - radius))

    def probes(df: DataFrame) -> DataFrame:
        cut = df.select("hi", "lo", *[block(i).alias(f"b{i}") for i in range(blocks)])
        keys = F.array(*[F.struct(F.lit(n).alias("t"), F.xxhash64(*[F.col(f"b{i}") for i in t]).alias("k")) for n, t in enumerate(tables)])
        return cut.select("hi", "lo", F.explode(keys).alias("e")).select("hi", "lo", "e.t", "e.k")

    q = probes(queries).select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "t", "k")
    pairs = q.join(probes(classes), ["t", "k"]).where((F.col("q_hi") != F.col("hi")) | (F.col("q_lo") != F.col("lo")))
    apart = F.bit_count(F.col("q_hi").bitwiseXOR(F.col("hi"))) + F.bit_count(F.col("q_lo").bitwiseXOR(F.col("lo")))
    return pairs.withColumn("distance", apart).where(F.col("distance") <= radius).select("q_hi", "q_lo", "hi", "lo", "distance").distinct()


def edited_likeness(docs: DataFrame, per_range: int = 2000) -> DataFrame:
    """Each document against its edited text and against the next document, in descending doc_id.

    The edited text has its last floor(n/2) code points replaced by the first as many of the next
    document (after the last: the first). Documents are dealt out once, by ranges of doc_id; a
    range's last document finds its successor because the head of the next range is copied in.
    Null ids come last; rows with equal ids are ordered by text.
    """
    lowest = -(2**63)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)))
    cuts = id_cuts(base.select("_key"), "_key", per_range)
    base = base.withColumn("_seg", range_of(F.col("_key"), cuts))
    heads = {r["_seg"]: r["k"] for r in base.groupBy("_seg").agg(F.max("_key").alias("k")).collect()}
    order = sorted(heads, reverse=True)
    wanted = [(heads[nxt], seg) for seg, nxt in zip(order, order[1:] + order[:1], strict=True)]
    places = F.array(F.struct(F.col("_seg").alias("s"), F.lit(0).alias("f")))
    if wanted:
        ids, segs = F.lit([k for k, _ in wanted]).cast("array<bigint>"), F.lit([s for _, s in wanted]).cast("array<int>")
        at = F.array_position(ids, F.col("_key")).cast("int")
        places = F.when(at > 0, F.concat(places, F.array(F.struct(F.get(segs, at - 1).alias("s"), F.lit(1).alias("f"))))).otherwise(places)
    rows = base.select("doc_id", "text", "_key", F.explode(places).alias("_e")).select("doc_id", "text", "_key", F.col("_e.s").alias("_seg"), F.col("_e.f").alias("_head"))
    by = W.partitionBy("_seg").orderBy("_head", F.desc("_key"), "text")
    half = F.expr("n_chars div 2").cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("_next", F.coalesce(F.lead("text").over(by), F.lit(""))).withColumn("_rn", F.row_number().over(by))
    rows = rows.select("doc_id", "_seg", "_head", "_rn", "n_chars", "text", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next", F.lit(1), half)).alias("_edited"))
    both = rows.select("_seg", "_rn", F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))).alias("_e"))
    prints = _votes(both.select("_seg", "_rn", F.col("_e.k").alias("_kind"), F.col("_e.t").alias("_t")), ["_seg", "_rn", "_kind"], "_t")
    sides = prints.groupBy("_seg", "_rn").agg(*[F.max(F.when(F.col("_kind") == k, F.col(h))).alias(f"{h}{k}") for k in (0, 1) for h in ("hi", "lo")])
    meta = rows.select("doc_id", "_seg", "_head", "_rn", "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"))
    zero = F.lit(0).cast("long")
    out = meta.join(sides, ["_seg", "_rn"], "left")
    out = out.select("doc_id", "_seg", "_head", "_rn", "n_chars", "edited_sha256", *[F.coalesce(c, zero).alias(c) for c in ("hi0", "lo0", "hi1", "lo1")])
    after = W.partitionBy("_seg").orderBy("_rn")
    out = out.withColumn("_nhi", F.lead("hi0").over(after)).withColumn("_nlo", F.lead("lo0").over(after)).where(F.col("_head") == 0)
    own = (F.col("hi0"), F.col("lo0"))
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _hex(*own).alias("fingerprint"),
        _hex(F.col("hi1"), F.col("lo1")).alias("edited_fingerprint"),
        likeness(own, (F.col("hi1"), F.col("lo1"))).alias("near_edited"),
        likeness(own, (F.col("_nhi"), F.col("_nlo"))).alias("near_next"),
    )
