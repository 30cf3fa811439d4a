"""Stems, the text index and cover density."""

import pytest

from verdigris.functions.stems import STOP_WORDS, stem

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consistency consist consistently consist consolation consol consolatory consolatori console consol
consolidating consolid consonant conson consorting consort conspicuously conspicu conspiracy conspiraci conspirators conspir constables constabl constancy constanc knackeries knackeri knacks knack knaves knave
knavish knavish kneaded knead kneeled kneel knees knee knightly knight knits knit knitted knit knives knive knocker knocker knopp knopp relational relat generously generous communities communiti hopping hop hoping hope
falling fall cries cri ties tie gas gas this this happy happi say say electricity electr controlling control dying die news news proceeds proceed inning inning sky sky toy toy by by abilities abil agreed agre
flies fli rational ration vietnamization vietnam hopefulness hope formative format adoption adopt probate probat rate rate cease ceas roll roll yelling yell""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(PAIRS[::2], PAIRS[1::2], strict=True)))
def test_stem(word, want):
    assert stem(word) == want


def test_stop_words():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) == 127


def brute_density(words, terms, weights):
    """Cover density over all intervals: those with every term that hold no smaller one; words are (stem or None, label)."""
    import itertools

    marks = [(i + 1, s, weights[label]) for i, (s, label) in enumerate(words) if s in terms]
    if {s for _, s, _ in marks} != set(terms):
        return None
    whole = [(a, b) for a, b in itertools.combinations_with_replacement(range(len(marks)), 2) if {s for _, s, _ in marks[a : b + 1]} == set(terms)]
    least = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    total = 0
    for a, b in least:
        inside = marks[a : b + 1]
        total += len(inside) / sum(1 / w for *_, w in inside) / (1 + marks[b][0] - marks[a][0] + 1 - len(inside))
    return round(total / (total + 1), 9)


def test_ranking_against_all_intervals(spark, tmp_path):
    import random

    from verdigris.operators import search

    r = random.Random(5)
    vocabulary = ["the", "run", "running", "runs", "cats", "cat", "happy", "of", "tables", "über", "42"]
    rows = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 2]))), " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 5, 30])))) for i in range(60)]
    rows += [(60, None, None), (61, "the of", "THE cat; RUNS!"), (62, "cat run", None), (63, "Über-42", "x_über")]
    df = spark.createDataFrame(rows, "id long, name string, body string").repartition(3)
    index = search.build_index(df, {"name": "A", "body": "C"}, str(tmp_path / "i"), buckets=5)
    asks = ["cat", "running cats", "the of", "", "happy cat runs", "über 42", "missing cat", "table table", "run the cat of"]
    got = search.ranked(index, spark.createDataFrame(list(enumerate(asks)), "query_id int, qtext string"), 1000).collect()
    words = lambda t: __import__("re").findall(r"[^\W_]+", (t or "").lower())
    want = []
    for q, text in enumerate(asks):
        terms = {stem(w) for w in words(text) if w not in STOP_WORDS}
        scores = []
        for i, name, body in rows:
            first = [(None if w in STOP_WORDS else stem(w), "A") for w in words(name)]
            while first and first[-1][0] is None:
                first.pop()
            second = [(None if w in STOP_WORDS else stem(w), "C") for w in words(body)]
            if terms and (score := brute_density(first + second, terms, search.WEIGHTS)) is not None:
                scores.append((-score, i))
        want += [(q, i, -s, n) for n, (s, i) in enumerate(sorted(scores), 1)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 60
    only = search.ranked(index, spark.createDataFrame([(0, "cat")], "query_id int, qtext string"), 5, allowed=df.where("id = 62")).collect()
    assert [x.id for x in only] == [62]


def test_empty_index(spark, tmp_path):
    from verdigris.operators import search

    index = search.build_index(spark.createDataFrame([], "id long, body string"), {"body": "B"}, str(tmp_path / "i"))
    asks = spark.createDataFrame([(0, "cat")], "query_id int, qtext string")
    assert search.ranked(index, asks, 5).collect() == search.bm25(index, asks).collect() == []


def test_a_query_reads_the_folders_of_its_words(spark, tmp_path):
    from verdigris.operators import search

    df = spark.createDataFrame([(i, f"word{i} common") for i in range(200)], "id long, body string")
    index = search.build_index(df, {"body": "B"}, str(tmp_path / "i"), buckets=50)
    plan = search.bm25(index, spark.createDataFrame([(0, "word7")], "query_id int, qtext string"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
