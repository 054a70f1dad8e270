"""Cases of the fourth round: whole jobs that the small tables don't show."""

import hashlib
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hireloom.functions import text, vectors
from hireloom.operators import documents, profiles, taxonomy
from hireloom.plans import registry
from hireloom.plans.profiles import planted_resumes
from hireloom.sources.views import Views
from tests.conftest import DATA

SKILLS = [
    (0, "Go"), (1, "Machine Learning"), (2, "Golang"), (3, "Power BI"), (4, "Site Reliability Engineering Team"), (5, "power-bi"), (6, "R&D"), (7, "AI"), (8, "a.i."), (9, ""), (10, None), (11, "Node.js"), (12, "C#"),
]
SYNONYMS = [(1, "ML"), (2, "go lang"), (6, "ms"), (4, "SRE"), (3, "sre"), (4, "reliability on call duty"), (0, "golang"), (12, "c sharp dot net"), (11, "node"), (77, "nobody")]
TEXTS = [
    "We go, then Go\nGo is used", "I go (Go)", "go lang or go or golang\nGolang, not go", "node and\nNode.js, node", "ML and Machine Learning", "Machine Learning\tml", "R&D ms", "ms of R & D", "AI a.i.", "AI, ai", "no skill\n\npower bi. Power BI",
    " Go\x1cgo ai\x85a.i.", "site reliability engineering team; reliability on call duty", "reliability on call duty\nsre", "C Sharp dot net!", "x " * 100 + "c#", "", None, ". .. \n+ #",
]


def plain_scan(value):
    """Hits of a text by dictionaries, read from the first token of the first line on."""
    key = text.normalize_key_py
    names = {key(n): i for i, n in SKILLS}
    others = {}
    for i, s in sorted(SYNONYMS):
        if i < len(SKILLS):
            others.setdefault(key(s), i)
    found, mentions = {}, {}
    for at, line in enumerate((value or "").split("\n")):
        tokens = [t for t in (t.strip(".") for t in re.findall("[a-z0-9+#.]+", line.lower())) if len(t) > 1]
        for run in (tokens[i : i + n] for n in range(1, 5) for i in range(len(tokens) - n + 1)):
            k = key(" ".join(run))
            i = names.get(k, others.get(k))
            if i is None or k in taxonomy.AMBIGUOUS and SKILLS[i][1] not in line.split():
                continue
            hit = ("exact", 1.0) if k in names else ("synonym", 0.95)
            mentions[i] = mentions.get(i, 0) + 1
            if i not in found or hit[1] > found[i][1]:
                found[i] = (*hit, " ".join(run), at, line[:140])
    return {(i, *hit, mentions[i]) for i, hit in found.items()}


def test_texts_are_scanned_for_names_and_synonyms(spark):
    """scan_text: runs of up to four tokens, synonyms, keys that are words too, the surest hit."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    skills = spark.createDataFrame(SKILLS, "skill_id long, name string")
    found = taxonomy.scan_text(docs, skills, synonyms=spark.createDataFrame(SYNONYMS, "skill_id long, synonym string"))
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add((r["skill_id"], r["match_type"], r["confidence"], r["matched_text"], r["line_no"], r["evidence"], r["mentions"]))
    want = {i: hits for i, t in enumerate(TEXTS) if (hits := plain_scan(t))}
    assert got == want
    assert want[3] == {(11, "exact", 1.0, "node.js", 1, "Node.js, node", 3)} and want[6] == {(6, "synonym", 0.95, "ms", 0, "R&D ms", 1)} and 1 not in want and 9 not in want


@pytest.fixture
def notes(tmp_path):
    """Tables whose parts have names of up to four words, one the other way round, and short ones."""
    names = ["blue bolt", "old deep red sea", "learn deep", "very deep learn", "Go", "go", "go far", "AI", "sea", "ms", "far go ahead now", None, "blue-bolt"]
    c = duckdb.connect()
    c.execute("create table part as select unnest(range(len($1))) as p_partkey, unnest($1) as p_name", [names])
    c.sql("create table orders as select range as o_orderkey, range as o_custkey from range(40)")
    c.sql("create table lineitem as select (range * 7 % 41)::bigint as l_orderkey, (range % 13)::bigint as l_partkey, (range % 5)::int as l_linenumber from range(200)")
    for t in ("part", "orders", "lineitem"):
        c.sql(f"copy {t} to '{tmp_path}/{t}.parquet'")
    return c, str(tmp_path)


def test_scan_of_notes_is_whole(spark, notes):
    c, at = notes
    want = c.sql(registry.oracle_sql()["scan_text"])
    rows = set(want.fetchall())
    df = registry.queries()["scan_text"](spark, at)
    assert sorted(map(repr, map(tuple, df.select(*want.columns).collect()))) == sorted(map(repr, rows))
    texts = {(r[want.columns.index("match_type")], r[want.columns.index("matched_text")]) for r in rows}
    assert {("exact", "far go ahead now"), ("exact", "very deep learn"), ("synonym", "deep learn"), ("exact", "sea")} <= texts and ("exact", "ai") not in texts


def test_every_chunk_of_a_long_resume_is_embedded(spark):
    """candidate_embeddings: the end of a text counts like its beginning."""
    texts = {1: " ".join(f"word{i}" for i in range(9_000)), 2: "\n\n".join(f"part {i} " + "of a text " * 60 for i in range(70)), 3: "short", 4: None, 5: ""}
    rows = spark.createDataFrame([(i, f"Candidate: {i}", t) for i, t in texts.items()], "candidate_id long, document string, raw_text string")
    none = spark.createDataFrame([], "candidate_id long, text string")
    made = profiles.embed_rows(profiles.embedding_texts(rows, none, none)).where("kind = 'resume_chunk'").orderBy("candidate_id", "chunk_index").collect()
    for i, t in texts.items():
        want = documents.chunk_py(t)
        got = [r for r in made if r["candidate_id"] == i]
        assert [(r["chunk_index"], r["text"]) for r in got] == list(enumerate(want))
        assert len(want) > 48 or i > 2
        if want:
            assert np.allclose([r["vector"] for r in got], vectors.embed_many(want), atol=1e-6)
    assert {w for r in made if r["candidate_id"] == 1 for w in r["text"].split()} >= set(texts[1].split())


def whole_plain(value):
    tokens, key = text.tokenize_py(value), text.normalize_key_py(value)
    out = np.zeros(384)
    for names, weight in (["w:" + t for t in tokens], 1.0), ([f"b:{a}_{b}" for a, b in zip(tokens, tokens[1:])], 0.7), (["c:" + key[i : i + 3] for i in range(len(key) - 2)], 0.35):
        for name in names:
            v = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
            out[v % 384] += weight if v >> 63 else -weight
    out = np.sign(out) * np.log1p(np.abs(out))
    return out / np.linalg.norm(out)


def test_vectors_of_candidates_read_whole_texts(spark):
    """candidate_embeddings: trigrams past the 4,000th character of a text's key count too."""
    texts = ["Candidate: A\nSkills: " + ", ".join(f"skill{i} of {i % 7}" for i in range(900)), "Candidate: B", "É" * 5_000, "one" * 3_000 + "two"]
    rows = spark.createDataFrame([(i, "profile", 0, t) for i, t in enumerate(texts)], "candidate_id long, kind string, chunk_index int, text string")
    got = [r["vector"] for r in profiles.embed_rows(rows).orderBy("candidate_id").collect()]
    assert np.allclose(got, [whole_plain(t) for t in texts], atol=1e-6)
    assert [np.allclose(a, b, atol=1e-6) for a, b in zip(got, vectors.embed_many(texts))] == [False, True, True, False]


def test_texts_are_embedded_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(vectors, "CHARS", 10)
    assert list(vectors._steps(["a" * 4, None, "b" * 6, "c", "d" * 30, "", "e"])) == [["a" * 4, None, "b" * 6], ["c"], ["d" * 30], ["", "e"]]
    monkeypatch.setattr(vectors, "AT_ONCE", 2)
    assert list(vectors._steps(["a", "b", "c"])) == [["a", "b"], ["c"]] and list(vectors._steps([])) == []


def test_candidates_with_many_orders_keep_all_chunks(spark, tmp_path):
    for p in Path(DATA).glob("*.parquet"):
        if p.stem != "orders":
            (tmp_path / p.name).symlink_to(p)
    duckdb.connect().sql(f"copy (select * replace (o_custkey % 2 + 1 as o_custkey) from '{DATA}/orders.parquet') to '{tmp_path}/orders.parquet'")
    want = {r["doc_id"]: len(documents.chunk_py(r["text"])) for r in planted_resumes(Views(spark, str(tmp_path))).collect()}
    found = registry.queries()["candidate_embeddings"](spark, str(tmp_path)).where("kind = 'resume_chunk'")
    counted = found.groupBy("candidate_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"))
    assert {r["candidate_id"]: (r["n"], r["last"] + 1) for r in counted.collect()} == {i: (n, n) for i, n in want.items()}
    assert max(want.values()) > 24
