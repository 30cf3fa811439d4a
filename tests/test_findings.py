"""Findings on larger tables: rounding, windows, the text index, batches of queries."""

from verdigris.operators import style


def test_style_rounds_and_bounds_words_as_its_sql(spark):
    sentences = ["one two three four five six seven eight nine ten."] * 23 + ["one two three four five six seven eight nine."] * 17
    rows = [(0, " ".join(sentences)), (1, "lüso beso so, -so _so ßo")]
    got = {r.id: r for r in style.analyse(spark.createDataFrame(rows, "id long, text string"), "id", ["so"], ["so"], ["may"], ["th"]).collect()}
    assert got[0].words == 383 and got[0].mean_len == 9.57  # 383 / 40 is below 9.575 in binary
    assert got[1].connectives["so"] == round(3 * 1000 / got[1].words, 3)  # after the letter ü, "so" and "-so"; no match in beso and _so


def test_fold_grows_with_its_rows(spark):
    """One pair of a subject and an object with 60,000 operations: a window that looks ahead row by row took minutes."""
    import time

    from pyspark.sql import functions as F

    from verdigris.operators import beliefs

    n = 60_000
    p = F.when(F.col("id") % 3 == 0, "mastered").otherwise("struggles_with")
    ops = spark.range(n).select(
        F.lit(0).alias("tenant"), (F.col("id") % 2).alias("session"), F.lit("a").alias("s"), F.lit("b").alias("o"), F.col("id").cast("timestamp").alias("ts"), "id",
        p.alias("p"), F.lit(0.5).alias("confidence"), F.lit("").alias("evidence"), F.lit("add").alias("op"),
    )
    began = time.time()
    got = {(r.p, r.session, r.valid_from.timestamp()): r.invalidated_at for r in beliefs.fold(ops).collect()}
    assert time.time() - began < 60
    assert got["struggles_with", 1, 1.0].timestamp() == 3 and got["mastered", 0, 0.0].timestamp() == 1
    assert got["struggles_with", 0, n - 2] is None and len(got) == n


def test_graph_queries_fold_the_events_once(spark):
    """The hops' plan reads the written relations; before, each direction of each hop folded all events anew."""
    from tests.conftest import SF
    from verdigris.plans import graph_queries

    for query in (graph_queries.two_hop, graph_queries.vector_subgraph, graph_queries.session_graph):
        assert "events.parquet" not in query(spark, SF)._jdf.queryExecution().toString()


def test_searches_at_once_agree_with_the_index(spark, tmp_path, monkeypatch):
    """A batch without an index finds what the index finds, in one scan or in several; before, each query wrote the whole index first."""
    import random

    from verdigris.operators import search

    r = random.Random(3)
    vocabulary = ["the", "run", "running", "runs", "cats", "cat", "happy", "of", "tables", "über", "42", "do", "doing"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2]))), " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 40])))) for i in range(80)] + [(80, None, None)]
    df = spark.createDataFrame(rows, "id int, name string, body string").repartition(3)
    asks = spark.createDataFrame(list(enumerate(["cat", "running cats", "cats run", "the of", "", "happy cat runs", "über 42", "missing cat", "tables", "doings"])), "query_id int, qtext string")
    index = search.build_index(df, {"name": "A", "body": "C"}, str(tmp_path / "i"), buckets=5)
    told = lambda x: sorted(map(tuple, x.select("query_id", "id", "score", "rank").collect()))
    want, plain = told(search.ranked(index, asks, 7)), told(search.bm25(index, asks, 7, label="C"))
    assert len(want) > 30 and len(plain) > 40
    for limit in (10_000, 3):
        monkeypatch.setattr(search, "QUERY_LIMIT", limit)
        assert told(search.ranked_at_once(df, {"name": "A", "body": "C"}, asks, 7)) == want
        assert told(search.bm25_at_once(df, "body", asks, 7)) == plain
    words = {x.word: (x.stem, x.docs) for x in index.lexicon().where("label = 'C'").collect()}
    assert {x.word: (x.stem, x.docs) for x in search.lexicon(df, "body").collect()} == words


def test_scan_grows_with_the_words(spark):
    """60,000 words of one text: an index repeated the whole list of words for each of them."""
    import time

    from verdigris.operators import search

    df = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(60_000)) + " cat") for i in range(4)], "id long, body string")
    began = time.time()
    got = search.ranked_at_once(df, {"body": "B"}, spark.createDataFrame([(0, "cats w7")], "query_id int, qtext string"), 2).collect()
    assert [x.id for x in sorted(got, key=lambda x: x.rank)] == [0, 1] and time.time() - began < 30


def test_memories_are_ranked_without_shuffled_pairs(spark, monkeypatch):
    """All memories share a word with all queries; the blocks give what all pairs give, and no join makes the pairs."""
    import datetime
    import random

    from verdigris.operators import memory

    r = random.Random(4)
    some = lambda n: [r.choice(["a", "cat", "Sat", "user", "x1", "über"]) for _ in range(n)]
    day = lambda: r.choice([None, datetime.datetime(2024, 1, r.randint(1, 3))])
    known = [(i, " ".join(["the", *some(2)]) if i else None, r.choice([None, [], some(2), [None, "cat"]]), r.choice([None, "", "user cat-x1"]), r.choice([None, 1, 2, 9]), day()) for i in range(60)]
    asks = [(i, " ".join(["The", *some(r.randint(0, 3))])) for i in range(25)] + [(25, None), (26, "What do you know"), (27, "...")]
    memories = spark.createDataFrame(known, "id int, memory string, tags array<string>, topic string, importance int, ts timestamp_ntz")
    queries = spark.createDataFrame(asks, "query_id int, text string")
    split = lambda t: set(filter(None, __import__("re").split("[^a-z0-9]+", (t or "").lower())))
    want = []
    for q, text in asks[:25]:
        ws, scored = split(text), []
        for i, m, tags, topic, importance, ts in known:
            if both := len(ws & split(m)):
                score = both + 1.5 * any(t is not None and t.lower() in ws for t in tags or []) + any(w in (topic or "") for w in ws) + 0.4 * min(3, 3 if importance is None else importance)
                scored.append((-round(score, 6), ts is None, -ts.day if ts else 0, i))
        want += [(q, x[3], -x[0], n) for n, x in enumerate(sorted(scored)[:5], 1)]
    for block, few in ((16_384, 4_096), (7, 4)):
        monkeypatch.setattr(memory, "BLOCK", block)
        monkeypatch.setattr(memory, "ASKS", few)
        found = memory.relevant(memories, queries)
        assert sorted(map(tuple, found.where("query_id < 26").collect())) == sorted(want)
    assert found.where("query_id = 26").count() == 5
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
