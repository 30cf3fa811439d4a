"""Operator 13: the prefix trie of conversations.

A node is a distinct sequence of first turns (role and text). Conversations are dealt out by the digest of
their first turn, many first turns to a group of about ``GROUP_ROWS`` turns, and each group builds its
tries inside ``applyInPandas``: every node points to its children by a dictionary of turn digests, and an
iterative postorder sums up the subtrees.

A first turn's subtrie of more than ``SUBTRIE_ROWS`` turns is repartitioned by its next turn, and so on
until every part fits. That recursion is unrolled: one aggregation counts the turns below every prefix,
and a conversation goes to the shortest of its prefixes whose count fits, so no task ever meets a subtrie
that is too large, and copies of long conversations cost no round a turn. The nodes above, and the root,
are few to a conversation; sums over their members give them: a node's subtree is made of the nodes that
its members stand for as smallest member, and those of one member are the end of its path. Conversations
whose path ends up there are hashed in a stream, in the order of their ids, not gathered.

Rows without a conv_id belong to no conversation. Null roles and texts are empty; turns that are null come
first, and equal ones follow the digest of their role and text. Repeated rows are turns of their own. An
empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from verdigris.llm.common import long_crc, settle
from verdigris.llm.mixing import WORD

SUBTRIE_ROWS = 4096
GROUP_ROWS = 4096
#: Rows of a table that is broadcast, counted first.
FEW = 50_000
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, n, digest, words) of each turn, n from 1 in the order of the turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("n"), "digest", "words")


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, part, n, digest, words), in the order of part and n, and all (conv_id).

    Of every conversation the first h turns, h its id's checksum modulo ``most``, become those of the
    first conversation of its block, or as many as that one has.
    """
    convs = turns.select("conv_id").distinct()
    h = (long_crc("conv_id") % most).alias("h")
    own = turns.select("conv_id", F.lit(1).alias("part"), "n", "digest", "words", h).where(F.col("n") > F.col("h")).drop("h")
    heads = turns.where((F.col("conv_id") % block == 0) & (F.col("n") < most)).withColumnRenamed("conv_id", "base")
    new = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), h).join(heads, "base").where(F.col("n") <= F.col("h"))
    return new.select("conv_id", F.lit(0).alias("part"), "n", "digest", "words").unionByName(own), convs


def paths(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, size, digest, words, prefix, above): the digest of each turn's prefix and of the one before it, b'' for none."""
    own = W.partitionBy("conv_id")
    rows = turns.select("conv_id", F.row_number().over(own.orderBy("part", "n")).alias("pos"), F.count("*").over(own).alias("size"), "digest", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now = None, b""
        for b in batches:
            prefix, above = [], []
            for conv, digest in zip(b["conv_id"].to_pylist(), b["digest"].to_pylist(), strict=True):
                now = b"" if conv != last else now
                above.append(now)
                now = hashlib.sha256(now + digest).digest()[:16]
                prefix.append(now)
                last = conv
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prefix, pa.binary()), pa.array(above, pa.binary())], [*b.schema.names, "prefix", "above"])

    return rows.sortWithinPartitions("conv_id", "pos").mapInArrow(run, "conv_id long, pos int, size long, digest binary, words long, prefix binary, above binary")


EMPTY = hashlib.sha256(b"").hexdigest()


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a group's tries, from (key, conv_id, pos, size, digest, words, up, above)."""
    rows = rows.sort_values(["conv_id", "pos"])
    roots: dict[bytes, int] = {}
    children: list[dict[bytes, int]] = []
    smallest, depth, parent, n, words, up, above, ends = [], [], [], [], [], [], [], {}
    last = at = None
    for key, conv, pos, size, digest, w, u, a in zip(*(rows[c].tolist() for c in ("key", "conv_id", "pos", "size", "digest", "words", "up", "above")), strict=True):
        inner = conv == last
        pointers, name = (children[at], digest) if inner else (roots, key)
        node = pointers.get(name)
        if node is None:  # conversations come in ascending order, so the first one here is the smallest
            node = pointers[name] = len(children)
            children.append({})
            smallest.append(conv)
            depth.append(pos)
            parent.append(at if inner else -1)
            n.append(0)
            words.append(w)
            up.append(None if inner else u)
            above.append(None if inner else a)
        n[node] += 1
        if pos == size:
            ends.setdefault(node, []).append(conv)
        last, at = conv, node
    own = [(k - 1) * w for k, w in zip(n, words, strict=True)]
    saved, leaves = own.copy(), [0] * len(own)
    stack = [(r, iter(children[r].values())) for r in roots.values()]
    while stack:  # postorder: a node is left when its children are done
        node, rest = stack[-1]
        child = next(rest, None)
        if child is not None:
            stack.append((child, iter(children[child].values())))
            continue
        stack.pop()
        leaves[node] += not children[node]
        if parent[node] >= 0:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    sha = [hashlib.sha256(",".join(map(str, ends[i])).encode()).hexdigest() if i in ends else EMPTY for i in range(len(own))]
    over = [u if p < 0 else smallest[p] for p, u in zip(parent, up, strict=True)]
    return pd.DataFrame({"conv_id": smallest, "depth": depth, "parent_conv_id": over, "n_convs": n, "n_children": [len(c) for c in children], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": sha, "own": own, "above": above})


def _ends(rows: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of (prefix, conv_id): each prefix's ids in ascending order go through the hash one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        for b in batches:
            done = []
            for prefix, conv in zip(b["prefix"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
                if prefix != last:
                    if sha is not None:
                        done.append((last, sha.hexdigest()))
                    last, sha = prefix, hashlib.sha256(str(conv).encode())
                else:
                    sha.update(b",%d" % conv)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([s for _, s in done])], ["prefix", "ends_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([sha.hexdigest()])], ["prefix", "ends_sha256"])

    return rows.select("prefix", "conv_id").repartition("prefix").sortWithinPartitions("prefix", "conv_id").mapInArrow(run, "prefix binary, ends_sha256 string")


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def prefix_trie(turns: DataFrame, convs: DataFrame, subtrie_rows: int = SUBTRIE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """NODE rows of the trie of ``turns`` (conv_id, part, n, digest, words); ``convs`` also has the conversations without a turn."""
    rows = settle(paths(turns))
    convs = settle(convs)
    least = convs.agg(F.min("conv_id")).first()[0]
    # prefixes with too many turns below them
    below = rows.groupBy("prefix").agg(F.sum(F.col("size") - F.col("pos") + 1).alias("turns"), F.min("conv_id").alias("least"), F.count("*").alias("n"), F.first("words").alias("words"), F.first("above").alias("above"))
    large = settle(below.where(F.col("turns") > subtrie_rows).drop("turns"))
    top = rows.join(_few(large.select("prefix", "least", "n")), "prefix").select("conv_id", "pos", "size", "prefix", "least", ((F.col("n") - 1) * F.col("words")).alias("whole"))
    top = settle(top)
    stop = top.groupBy("conv_id").agg(F.max("pos").alias("stop"), F.max_by("least", "pos").alias("up"))
    rest = rows.join(stop, "conv_id", "left").where(F.col("pos") > F.coalesce("stop", F.lit(0)))
    key = F.first("prefix").over(W.partitionBy("conv_id").orderBy("pos"))
    many = max(1, -(-rows.count() // group_rows))
    keyed = rest.select(key.alias("key"), "conv_id", "pos", "size", "digest", "words", F.coalesce("up", F.lit(least).cast("long")).alias("up"), "above")
    dealt = keyed.groupBy(F.pmod(F.xxhash64("key"), F.lit(many)).alias("group"))
    nodes = settle(dealt.applyInPandas(lambda g: build_tries(g), f"{NODE}, own long, above binary"))
    # the nodes above them: the root and the large prefixes
    kids = nodes.where(F.col("above").isNotNull()).select("above").unionByName(large.select("above")).groupBy("above").agg(F.count("*").alias("n_children")).withColumnRenamed("above", "prefix")
    leafless = large.select("prefix", "least").join(kids, "prefix", "left_anti").select(F.col("least").alias("conv_id"), F.lit(1).alias("leaf"), F.lit(0).alias("own"))
    if_bare = convs.where(F.lit(rows.isEmpty())).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).where(F.col("n") > 0).select("conv_id", F.lit(1).alias("leaf"), F.lit(0).alias("own"))
    deep = nodes.select("conv_id", (F.col("n_children") == 0).cast("int").alias("leaf"), "own").unionByName(leafless).unionByName(if_bare)
    deep = deep.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("own").alias("deep"))
    size = rows.where(F.col("pos") == 1).select("conv_id", "size")
    base = convs.join(size, "conv_id", "left").select("conv_id", F.lit(0).alias("pos"), F.coalesce("size", F.lit(0)).alias("size"), F.lit(b"").alias("prefix"), F.lit(least).cast("long").alias("least"), F.lit(0).cast("long").alias("whole"))
    high = base.unionByName(top).join(deep, "conv_id", "left")
    stands = F.when(F.col("least") == F.col("conv_id"), F.col("whole")).otherwise(0)
    onward = F.sum(stands).over(W.partitionBy("conv_id").orderBy(F.desc("pos"))) + F.coalesce("deep", F.lit(0))
    high = settle(high.select("conv_id", "pos", "size", "prefix", onward.alias("saved"), F.coalesce("leaves", F.lit(0)).alias("leaves")))
    sums = high.groupBy("prefix").agg(F.min("conv_id").alias("conv_id"), F.first("pos").cast("long").alias("depth"), F.count("*").alias("n_convs"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = large.select("prefix", F.col("above").alias("over")).join(sums.select(F.col("prefix").alias("over"), F.col("conv_id").alias("parent_conv_id")), "over")
    upper = sums.join(parents.drop("over"), "prefix", "left").join(kids, "prefix", "left").join(_ends(high.where(F.col("pos") == F.col("size"))), "prefix", "left")
    upper = upper.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return nodes.drop("own", "above").unionByName(upper)


def report(conversations: DataFrame, subtrie_rows: int = SUBTRIE_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The trie of the rebuilt conversations."""
    turns, convs = rebuilt(settle(numbered(conversations)))
    return prefix_trie(turns, convs, subtrie_rows, group_rows)


_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda s, x: xor(s >> 8, list_reduce(list_prepend(xor(s, x) & 255, range(8)::BIGINT[]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)))"""
TRIE_SQL = rf"""WITH numbered AS (SELECT conv_id AS c, COALESCE(role, '') AS role, COALESCE(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, ''))) AS n
      FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 20 AS base, xor({_CRC}, 4294967295::BIGINT) % 4 AS h FROM (SELECT DISTINCT c FROM numbered)),
    turns AS (SELECT v.c, 0 AS part, n, role, text FROM convs v JOIN numbered b ON b.c = v.base AND n <= h UNION ALL SELECT c, 1, n, role, text FROM convs JOIN numbered USING (c) WHERE n > h),
    paths AS (SELECT c, list(struct_pack(role := role, text := text)) OVER (PARTITION BY c ORDER BY part, n) AS prefix, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, COUNT(*) OVER (PARTITION BY c) AS size FROM turns
      UNION ALL SELECT c, [], 0, COALESCE(size, 0) FROM convs LEFT JOIN (SELECT c, COUNT(*) AS size FROM turns GROUP BY c) USING (c)),
    nodes AS (SELECT prefix, len(prefix) AS depth, MIN(c) AS conv_id, COUNT(*) AS n_convs, ANY_VALUE(words) AS words, sha256(COALESCE(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(prefix) = size), '')) AS ends_sha256 FROM paths GROUP BY prefix),
    kids AS (SELECT list_slice(prefix, 1, depth - 1) AS prefix, COUNT(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
    full_ AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.prefix = n.prefix),
    below AS (SELECT list_slice(prefix, 1, k) AS prefix, SUM((n_children = 0)::INT) AS n_leaves, SUM((n_convs - 1) * words) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS k FROM full_) GROUP BY 1)
    SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
    FROM full_ f JOIN below b ON b.prefix = f.prefix LEFT JOIN nodes p ON f.depth > 0 AND p.depth = f.depth - 1 AND p.prefix = list_slice(f.prefix, 1, f.depth - 1)"""
