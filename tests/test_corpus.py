"""Classification, isolation, profiles and the session graph on small cases."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdigris.functions import corpus
from verdigris.operators import beliefs, graph, tables
from verdigris.sources.records import json_lines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_paths_without_a_folder(spark):
    for path, kind, source in [("a.txt", "written", "lecture"), ("/x/the_batch/a.txt", "newsletter", "newsletter"), ("transcripts/a.txt", "spoken", "transcripts"), ("/x/the_batch/old/a.txt", "written", "lecture")]:
        assert one(spark, corpus.corpus_kind(F.lit(path))) == kind
        assert one(spark, corpus.source_type(F.lit(path))) == source


def test_own_text(spark):
    def own(author, text):
        return one(spark, corpus.own_text(F.lit(author), F.lit(text), ["ada"]))

    assert own("Ada L.", "x") and own("Bob", "by ADA") and own("", "Well, I think so") and own(None, "I find it good")
    assert not own("Bob", "I think so") and not own(None, None) and not own("", "x" * 500 + "ada")


def test_authority_is_clamped(spark):
    def prior(kind, editorial, mine, name):
        return one(spark, corpus.folder_authority(F.lit(kind), F.lit(editorial), F.lit(mine), F.lit(name)))

    assert prior("blog_posts", False, False, "working-ai-1.txt") == 0.15
    assert prior("blog_posts", False, None, "x") == 0.75 and prior("pdfs", False, None, "HODL.txt") == 0.8 and prior(None, False, None, "x") == 0.5


def test_editorial(spark):
    text = "a\n\nDear friends,\none\n\nTwo\n\nNEWS\nDear Friends, no"
    assert one(spark, corpus.editorial(F.lit(text))) == "Dear friends,\none\n\nTwo"
    assert one(spark, corpus.editorial(F.lit("dear friends"))) == "" and one(spark, corpus.editorial(F.lit(None).cast("string"))) == ""


def test_structured_falls_back(spark):
    rows = spark.createDataFrame([("a.txt",), ("Lecture-1.txt",), (None,)], "name string")
    assert [r.name for r in corpus.structured(rows).collect()] == ["Lecture-1.txt"]
    assert corpus.structured(rows, hints=["zz"]).count() == 3 and corpus.structured(rows.limit(0)).count() == 0


def test_seeded_sample_prefers(spark):
    rows = spark.range(40).withColumn("_other", F.lit(1))
    first = [r.id for r in corpus.seeded_sample(rows, "id", 5, 1, F.col("id") < 10).collect()]
    assert len(first) == 5 and max(first) < 10 and first == [r.id for r in corpus.seeded_sample(rows, "id", 5, 1, F.col("id") < 10).collect()]
    assert len({r.id for r in corpus.seeded_sample(rows, "id", 12, 1, F.col("id") < 10).collect()}) == 12


def test_tenant_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "tenant int, v string")
    assert [r.v for r in tables.isolated(rows, 1).collect()] == ["a"] and tables.isolated(rows, None).count() == 0
    assert [r.v for r in tables.checked(rows.where("tenant = 1"), 1).collect()] == ["a"]
    for tenant in (1, None):
        with pytest.raises(PySparkException, match="another tenant"):
            tables.checked(rows, tenant).collect()


def test_malformed_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in json_lines(spark, f"{tmp_path}/a.jsonl", "a long").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a"\n')
    with pytest.raises((PySparkException, Py4JJavaError), match="FAILED_READ_FILE|MALFORMED_RECORD"):
        json_lines(spark, f"{tmp_path}/b.jsonl", "a long").collect()


def test_profiles(spark):
    rows = [("a", "works_at", "Director"), ("b", "researches", "x"), ("c", "mastered", "p"), ("c", "mastered", "q"), ("d", "is", "undergraduate"), ("e", "prefers", "short"), ("f", "is", ""), ("g", "is", None)]
    got = {r.s: (r.level, r.profile) for r in beliefs.learner_profiles(spark.createDataFrame(rows, "s string, p string, o string")).collect()}
    assert {s: level for s, (level, _) in got.items()} == {"a": "business", "b": "advanced", "c": "intermediate", "d": "beginner", "e": "unknown", "f": "unknown", "g": "unknown"}
    assert got["b"][1] == "LEARNER PROFILE: advanced. Role: research. Professional context: x."
    assert got["f"][1] == "LEARNER PROFILE: unknown."


def test_session_graph_scores(spark):
    nodes = spark.createDataFrame([("s", "Student"), ("a", "Concept"), ("b", "Concept"), ("c", "Concept"), ("d", "Concept"), ("e", "Concept")], "node string, type string")
    edges = spark.createDataFrame([("s", "a", 2.0), ("b", "a", 0.5), ("d", "e", 0.4)], "s string, o string, weight double")
    got = {r.node: (r.hop, r.score) for r in graph.session_graph(nodes, edges).collect()}
    assert got == {"s": (0, 1.0), "a": (1, 1.0), "b": (2, 0.405), "c": (1, 0.45), "d": (1, 0.36), "e": (1, 0.36)}
    empty = graph.session_graph(nodes.where("type = 'Concept'"), edges.limit(0)).collect()
    assert {(r.hop, r.score) for r in empty} == {(1, 0.45)}
