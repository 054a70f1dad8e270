import pytest
from pyspark.sql import functions as F

from hireloom.operators import graph, matching, retrieval, taxonomy
from hireloom.plans import matches
from hireloom.sources import skills_csv
from hireloom.streaming import events as ev

EDGES = [
    ("Candidate:1", "Skill:python", "HAS_SKILL", 1.0), ("Candidate:1", "Skill:fastapi", "HAS_SKILL", 0.9), ("Candidate:2", "Skill:python", "HAS_SKILL", 0.8),
    ("Candidate:2", "Skill:apachespark", "HAS_SKILL", 1.0), ("Skill:python", "Skill:fastapi", "RELATED_TO", 0.6), ("Candidate:1", "Company:zentara", "WORKED_AT", 1.0),
]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "src string, dst string, relation string, weight double")


def seeds(spark, *keys):
    return spark.createDataFrame([(k, k) for k in keys], "seed string, key string")


def test_traverse(spark, edges):
    got = {r["node"]: (r["weight"], r["depth"]) for r in graph.traverse(edges, seeds(spark, "Candidate:2"), 2).collect()}
    assert got == {"Candidate:2": (1.0, 0), "Skill:python": (0.8, 1), "Skill:apachespark": (1.0, 1), "Skill:fastapi": (0.48, 2)}
    assert all(0 < w <= 1 and d <= 2 for w, d in got.values())


def test_neighbours_and_paths(spark, edges):
    assert {r["other"] for r in graph.neighbours(edges, "Skill:python").collect()} == {"Candidate:1", "Candidate:2", "Skill:fastapi"}
    far = {r["node"]: r["distance"] for r in graph.shortest_paths(edges, seeds(spark, "Candidate:2"), 3).collect()}
    assert far["Candidate:1"] == 2 and far["Company:zentara"] == 3


def test_dangling_edges_are_dropped_and_later_ones_win(spark, edges):
    nodes = spark.createDataFrame([("Candidate:1",), ("Skill:python",)], "key string")
    again = spark.createDataFrame([("Candidate:1", "Skill:python", "HAS_SKILL", 0.2)], edges.schema)
    assert [r["weight"] for r in graph.upsert_edges([edges, again], nodes).collect()] == [0.2]


def test_weights_sum_to_one():
    assert abs(sum(matching.component_weights({"skill": 3, "project": -1}).values()) - 1) < 1e-12


def test_ranks_are_dense_and_descending(views):
    rows = matches.match_ranked(views).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert all(a["overall"] >= b["overall"] for a, b in zip(rows, rows[1:]))


def test_experience_score(spark):
    years = spark.createDataFrame([(0.0,), (2.5,), (5.0,), (20.0,)], "y double")
    band = matching.Request(["a"], min_years=5.0, max_years=10.0)
    assert [r[0] for r in years.select(matching.experience_score(F.col("y"), band)[0]).collect()] == [0.0, 43.53, 100.0, 88.0]
    assert matching.experience_score(F.col("y"), matching.Request(["a"]))[1] is False


def test_fuzzy_resolution(spark):
    skills = spark.createDataFrame([(1, "Kubernetes"), (2, "C++"), (3, "Spark")], "skill_id long, name string")
    synonyms = spark.createDataFrame([(1, "k8s")], "skill_id long, synonym string")
    asked = spark.createDataFrame([("Kubernetess",), ("K8S",), ("c++",), ("Cobol",)], "phrase string")
    got = {r["phrase"]: (r["skill_id"], r["match_type"]) for r in taxonomy.resolve(asked, skills, synonyms).collect()}
    assert got == {"Kubernetess": (1, "fuzzy"), "K8S": (1, "synonym"), "c++": (2, "exact"), "Cobol": (None, "none")}


def test_parse_query():
    got = retrieval.parse_query("Python developer with 5+ years in Pune", ["Python", "Spark"])
    assert (got["min_years"], got["skills"], got["location"]) == (5.0, ["Python"], "Pune")
    assert retrieval.parse_query("engineer in Spark", ["Spark"])["location"] is None


def test_import_twice_creates_nothing(spark):
    rows = skills_csv.parse_rows(spark.createDataFrame(skills_csv.SAMPLE, skills_csv.SAMPLE_COLUMNS))
    none = spark.createDataFrame([], "key string, skill_id long")
    first = skills_csv.import_skills(rows, none)
    assert first["created"].count() == 2 and first["parents"].count() == 1 and first["synonyms"].count() == 2
    known = first["created"].select("key", F.lit(1).cast("long").alias("skill_id"))
    assert skills_csv.import_skills(rows, known)["created"].count() == 0


def test_csv_round_trip(spark, tmp_path):
    rows = skills_csv.parse_rows(spark.createDataFrame(skills_csv.SAMPLE, skills_csv.SAMPLE_COLUMNS))
    skills_csv.write(rows, f"file://{tmp_path}/out")
    again = skills_csv.read(spark, f"file://{tmp_path}/out")
    assert [r["skill_name"] for r in again.orderBy("skill_name").collect()] == ["Django", "Python"]
    assert skills_csv.check_files(spark, f"file://{tmp_path}/out/*.csv").where("refused is null").count() >= 1


def test_rate_limits(spark):
    rows = [(i, 1, f"2024-01-01 00:00:{s:02d}") for i, s in enumerate([0, 1, 2, 9, 10, 11])]
    events = spark.createDataFrame(rows, "event_id long, user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    every = {r["event_id"]: r["hits"] for r in ev.sliding_hits(events, 10, 2).collect()}
    assert every == {0: 1, 1: 2, 2: 3, 3: 4, 4: 4, 5: 4}
    kept = {r["event_id"]: r["allowed"] for r in ev.accepted_hits(events, 10, 2).collect()}
    assert kept == {0: True, 1: True, 2: False, 3: False, 4: False, 5: True}


def test_stream_results_stay_off_the_driver(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    rows = [(i % 50, i % 7, "view", None) for i in range(80)]
    data = spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("event_id") * 10))
    data.write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none"))
    for at, append, complete in (("in", 80, 50), ("none", 0, 0)):
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / at))
        got = ev.run_available(stream, f"a_{at}", "append", f"file://{tmp_path}/check-a-{at}")
        assert got.count() == append and (not append or all(f.endswith(".parquet") for f in got.inputFiles()) and got.inputFiles())
        counted = stream.groupBy("event_id").count()
        got = ev.run_available(counted, f"c_{at}", "complete", f"file://{tmp_path}/check-c-{at}")
        assert got.count() == complete and (not complete or got.inputFiles())


def test_accepted_hits_over_batches(spark):
    rows = [(i, [None, 1, 1, (1 << 60) + 1][i % 4], (i * 37) % 1000) for i in range(600)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {}
    for user in {r[1] for r in rows}:
        held = []
        for i, _, t in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            held = [h for h in held if h >= t - 60]
            want[i] = (user, len(held) < 3)
            if want[i][1]:
                held.append(t)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "50")
    try:
        found = ev.accepted_hits(events, 60, 3)
        got = {r["event_id"]: (r["user_id"], r["allowed"]) for r in found.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == want and "FlatMapGroups" not in found._jdf.queryExecution().toString()


def test_document_tokens_and_ngrams_are_whole(spark):
    import re
    from collections import Counter

    from hireloom.functions.text import STOPWORDS
    from hireloom.plans import registry
    from tests.conftest import DATA

    words, grams = Counter(), Counter()
    for row in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        found = [t.strip(".") for t in re.findall(r"[a-z0-9+#.]+", (row["text"] or "").lower())]
        found = [t for t in found if len(t) >= 2 and t not in STOPWORDS]
        words.update(found)
        grams.update(found + [f"{a} {b}" for a, b in zip(found, found[1:])])
    plans = registry.queries()
    assert len(words) > 200
    assert {r["token"]: r["n"] for r in plans["tokenize_all_counts"](spark, DATA).collect()} == words
    assert {r["gram"]: r["n"] for r in plans["ngram_document_counts"](spark, DATA).collect()} == grams


def test_similar_candidates_beyond_a_tile(spark, monkeypatch):
    """Small tiles and blocks, equal sets, ties by id, against all pairs; the plan joins no candidates by skill."""
    import random

    for name, value in (("ASKED_SETS", 7), ("OTHER_SETS", 11), ("TILE", (3, 4)), ("SKILLS", 2)):
        monkeypatch.setattr(graph, name, value)
    draw = random.Random(5)
    sets = {i: {draw.randrange(9) for _ in range(draw.randrange(1, 5))} for i in range(150)}
    links = spark.createDataFrame([(i, s) for i, x in sets.items() for s in x] + [(150, None)], "candidate_id long, skill_id long")
    alive = spark.createDataFrame([(i,) for i in range(151) if i % 4], "candidate_id long")
    asked = [i for i in range(151) if i % 3 == 0]
    got = graph.similar_candidates(links, alive, spark.createDataFrame([(i,) for i in asked], "candidate_id long"), 5)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan
    expected = []
    for i in asked:
        shared = sorted((-len(sets[i] & x), j) for j, x in sets.items() if j != i and sets[i] & x) if i in sets else []
        expected += [(i, j, -m, p) for p, (m, j) in enumerate(shared[:5], 1) if j % 4]
    assert sorted((r["candidate_id"], r["other_id"], r["shared"], r["place"]) for r in got.collect()) == sorted(expected)
