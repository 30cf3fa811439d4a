from verdigris.operators import memory


def test_relevant(spark):
    m = spark.createDataFrame([(1, "Learning rate decay", ["adam"], "training", 3, 1), (2, "Prefers rate tables", [], "style", 9, 2), (3, "Nothing shared", [], "x", 3, 3)], "id int, memory string, tags array<string>, topic string, importance int, ts int")
    q = spark.createDataFrame([(7, "which learning rate for adam training")], "query_id int, text string")
    assert [(r.id, r.score, r.rank) for r in memory.relevant(m, q).orderBy("rank").collect()] == [(1, 5.7, 1), (2, 2.2, 2)]


def test_remember(spark):
    schema = "owner int, memory string, tags array<string>, importance int, ts int"
    old = spark.createDataFrame([(1, "A", ["t"], 2, 1)], schema)
    new = spark.createDataFrame([(1, "a", ["t"], 3, 2), (1, "B", list("aabcdefgh"), 9, 3), (2, "B", [], 0, 4)], schema)
    got = {(r.owner, r.memory, r.importance, len(r.tags)) for r in memory.remember(old, new).collect()}
    assert got == {(1, "A", 2, 1), (1, "B", 3, 6), (2, "B", 1, 0)}


def test_mentions(spark):
    msgs = spark.createDataFrame([(1, "Is Gradient-Descent a b c d e f g?"), (2, "gradients"), (3, "")], "id int, text string")
    names = spark.createDataFrame([("gradient descent",), ("gradient",), ("a b c d e f g",), ("descents",)], "concept string")
    assert {(r.id, r.concept) for r in memory.mentions(msgs, names).collect()} == {(1, "gradient descent"), (1, "gradient"), (1, "a b c d e f g")}


def test_staged_envelope_adopt(spark):
    a = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id int, id int, rank int")
    b = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "query_id int, id int, rank int")
    assert [r.id for r in memory.staged(a, b, 3).orderBy("rank").collect()] == [5, 6, 7]
    s = spark.createDataFrame([("x", 0, 3.0), ("x", 1, 4.0), ("x", 2, 0.0)], "track string, n int, value double")
    assert [r.level for r in memory.envelope(s, 2).orderBy("bucket").collect()] == [1.0, 0.0]
    t, u = spark.createDataFrame([(1,), (2,)], "tenant int"), spark.createDataFrame([(1,)], "tenant int")
    asked = spark.createDataFrame([("p", 1), ("q", 2), ("r", 3)], "request string, tenant int")
    assert {r.request: r.tenant for r in memory.adopt_tenant(t, u, asked).collect()} == {"p": None, "q": 2, "r": None}
