"""Stream forms against batch forms whatever the micro-batches, and learning paths against Kahn's queue."""

import random
import time
from collections import deque

import pytest

from verdigris.operators import graph
from verdigris.streaming import limits, sentences


def feed(spark, folder, rows, schema, step, batches):
    """The rows that ``step`` gives over a stream whose files are ``batches`` of ``rows``; a stream with timeouts never ends by itself."""
    out, n = [], 0
    stream = None
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if stream is None:
            source = spark.readStream.schema(schema).parquet(f"{folder}/in")
            stream = step(source).writeStream.outputMode("append").option("checkpointLocation", f"{folder}/check").foreachBatch(lambda df, _: out.extend(df.collect())).trigger(processingTime="1 second").start()
        n += len(part)
        until = time.time() + 60
        while sum(p["numInputRows"] for p in stream.recentProgress) < n and time.time() < until and stream.isActive:
            time.sleep(0.3)
    assert sum(p["numInputRows"] for p in stream.recentProgress) == n
    stream.stop()
    return out


@pytest.mark.parametrize("cuts", [[], [7], [3, 11]])
def test_sentences_of_fragments(spark, tmp_path, cuts):
    r = random.Random(len(cuts))
    texts = {1: "The key idea is to follow the slope downhill. Then update the weights, e.g. by 0.5 of them! Done? Right. And some more words to end this one.", 2: "Dr. Ng said so yesterday in the lecture hall. Nothing else was said there."}
    rows = []
    for key, text in texts.items():
        at, n = 0, 0
        while at < len(text):
            size = r.randrange(1, 15)
            rows.append((key, n, text[at : at + size]))
            at, n = at + size, n + 1
    rows.sort(key=lambda x: x[1])
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    got = feed(spark, str(tmp_path), rows, "stream long, seq int, fragment string", sentences.of_stream, batches)
    for key, text in texts.items():
        found = [x.sentence for x in got if x.stream == key]
        whole = sentences.complete(text)[0]
        assert " ".join(found).split() == " ".join(whole).split()
        assert len(found) >= len(whole)  # a short one that comes in a batch of its own cannot join the one before
        if not cuts:
            assert found == whole


def test_token_buckets_in_any_batches(spark, tmp_path):
    r = random.Random(5)
    rows = sorted((float(r.randrange(300)), i, r.choice([1, 2])) for i in range(60))
    rows = [(k, i, s) for s, i, k in rows]
    schema = "key long, id long, seconds double"
    want = sorted(map(tuple, limits.allowed(spark.createDataFrame(rows, schema), 2.0).collect()))
    got = feed(spark, str(tmp_path), rows, schema, lambda s: limits.allowed_stream(s, 2.0), [rows[:25], rows[25:26], rows[26:]])
    assert sorted(map(tuple, got)) == want and {x[2] for x in want} == {True, False}


@pytest.mark.parametrize("seed", range(3))
def test_learning_paths_follow_the_queue(spark, seed):
    r = random.Random(seed)
    pairs = list({(f"c{r.randrange(12):02d}", f"c{r.randrange(12):02d}") for _ in range(16)})
    pairs = [(p, c) for p, c in pairs if p != c]
    ups = {}
    for p, c in pairs:
        ups.setdefault(c, set()).add(p)
    targets = sorted({c for _, c in pairs})
    want = {}
    for t in targets:
        need, stack = set(), [t]
        while stack:
            x = stack.pop()
            if x not in need:
                need.add(x)
                stack += ups.get(x, ())
        left = {x: len(ups.get(x, set()) & need) for x in need}
        queue, order = deque(sorted(x for x in need if not left[x])), []
        while queue:
            x = queue.popleft()
            order.append(x)
            for y in sorted(c for c in need if x in ups.get(c, ())):
                left[y] -= 1
                if not left[y]:
                    queue.append(y)
        order += sorted(need - set(order))
        want[t] = [x for x in order if x not in ("c01", "c05")]
    edges = spark.createDataFrame(pairs, "prerequisite string, concept string")
    asked = spark.createDataFrame([(t, ["c01", "c05"]) for t in targets], "target string, mastered array<string>")
    got = {}
    for x in sorted(graph.learning_paths(edges, asked).collect(), key=lambda x: x.step):
        got.setdefault(x.target, []).append(x.concept)
    assert got == {t: p for t, p in want.items() if p}
