"""The evidence ladder against a plain walk over every candidate."""

from dataclasses import replace
from types import SimpleNamespace

import numpy as np
import pytest

from hireloom.functions.text import normalize_key_py, similarity_py
from hireloom.functions.vectors import embed_py
from hireloom.operators import matching

SKILLS = [(1, "Python", None), (2, "Django", 1), (3, "Flask", 1), (4, "Java", None), (5, "Spring Boot", 4), (6, "JavaScript", None), (7, "TypeScript", 6), (8, "Celery", 2), (9, "Data Engineering", None)]
RELATED = [(1, 9, 0.6), (4, 6, 0.6), (2, 3, 0.6)]
LINKS = [
    (1, "python", 1), (1, "Celery", 8), (2, "Py Lang", 1), (3, "Celery", 8), (4, "Engineering Data", None), (4, "Cooking", None), (5, "Django", 2), (5, "Flask", 3),
    (6, "Spring-Boot", None), (7, "Data Engineerng", None), (8, None, None), (9, "TypeScript", 7), (9, "TypeScript", 7), (10, "", None), (11, "Spring Boots", None), (11, "Spring Bootz", None),
]


def walk(node, depth):
    parent = {i: p for i, _, p in SKILLS}
    sides = lambda i: sorted({b for a, b, _ in RELATED if a == i} | {a for a, b, _ in RELATED if b == i})
    seen, queue, out = {node}, [(node, 0, 1.0)], []
    while queue:
        at, level, weight = queue.pop(0)
        if level >= depth:
            continue
        ways = [(parent[at], 0.75, 0.75)] if parent[at] else []
        ways += [(c, 0.75, 0.7) for c in sorted(i for i, _, p in SKILLS if p == at)] + [(r, 0.6, 0.6) for r in sides(at)]
        for other, credit, hop in ways:
            if other not in seen:
                seen.add(other)
                out.append((other, credit * round(weight * hop, 4)))
                queue.append((other, level + 1, round(weight * hop, 4)))
    return out


def plain(links, asked, skills):
    """(match_type, score, matched_skill) of one candidate and one request (name, id)."""
    name, want = asked
    named = {i: n for i, n, _ in skills}
    display = named.get(want, name)
    held = [(named.get(s, raw), raw, s) for raw, s in links]
    by_id = sorted((n, raw) for n, raw, s in held if want is not None and s == want)
    if by_id:
        return ("exact" if any(normalize_key_py(raw) == normalize_key_py(display) for _, raw in by_id) else "synonym", 1.0, by_id[0][0])
    by_key = sorted(n for n, raw, s in held if raw is not None and normalize_key_py(raw) == normalize_key_py(name))
    if by_key:
        return ("exact", 1.0, by_key[0])
    near = sorted((-credit, named[other]) for other, credit in (walk(want, 2) if want else []) if any(s == other for *_, s in held))
    if near:
        return ("related", round(min(0.85, -near[0][0]) + 1e-9, 3), near[0][1])
    close = []
    for n, *_ in held:
        if n is not None:
            close.append((-max(float(np.dot(embed_py(n), embed_py(display))), 0.9 * similarity_py(display, n)), n))
    if close and -min(close)[0] >= 0.72:
        return ("semantic", round(min(0.8, -min(close)[0] * 0.8) + 1e-9, 3), min(close)[1])
    return ("missing", 0.0, None)


@pytest.fixture(scope="module")
def world(spark):
    return SimpleNamespace(
        spark=spark, skill=spark.createDataFrame(SKILLS, "skill_id long, name string, parent_skill_id long"), skill_relation=spark.createDataFrame(RELATED, "source_skill_id long, target_skill_id long, weight double"),
        candidate_skill=spark.createDataFrame(LINKS, "candidate_id long, raw_text string, skill_id long"),
    )


REQUEST = matching.Request(required=["Python", "python ", "Spring Boot", "Data Engineering"], preferred=["TypeScript", "PYTHON", "Basket Weaving"], mandatory=["PYTHON"])
ASKED = [("Python", 1), ("Spring Boot", 5), ("Data Engineering", 9), ("TypeScript", 7), ("Basket Weaving", None)]


def test_ladder_equals_a_plain_walk(spark, world):
    people = spark.range(1, 13).withColumnRenamed("id", "candidate_id")
    rows = matching.skill_evidence(world, people, REQUEST).collect()
    assert len(rows) == 12 * len(ASKED)
    got = {(r["candidate_id"], r["requested"]): (r["match_type"], r["score"], r["matched_skill"]) for r in rows}
    want = {(c, a[0]): plain([(raw, s) for i, raw, s in LINKS if i == c], a, SKILLS) for c in range(1, 13) for a in ASKED}
    assert got == want
    assert {kind for kind, *_ in got.values()} == {"exact", "synonym", "related", "semantic", "missing"}
    assert {r["requested"] for r in rows if r["mandatory"]} == {"Python"}
    assert got[3, "Python"] == ("related", 0.368, "Celery")  # two steps down: 0.75 of 0.7 x 0.7
    assert got[5, "Python"] == ("related", 0.525, "Django")


def test_names_count_by_meaning_only_if_asked(spark, world):
    people = spark.createDataFrame([(11,)], "candidate_id long")
    kinds = [{r["requested"]: r["match_type"] for r in matching.skill_evidence(world, people, replace(REQUEST, semantic=s)).collect()}["Spring Boot"] for s in (True, False)]
    assert kinds == ["semantic", "missing"]


def test_synonyms_of_the_taxonomy_name_the_skill(spark, world):
    people = spark.createDataFrame([(1,), (2,)], "candidate_id long")
    synonyms = spark.createDataFrame([("CPython", 1)], "synonym string, skill_id long")
    rows = matching.skill_evidence(world, people, matching.Request(required=["cpython"]), synonyms).collect()
    assert {r["candidate_id"]: r["match_type"] for r in rows} == {1: "exact", 2: "synonym"}


def test_nobody_and_nothing_held(spark, world):
    nobody = spark.createDataFrame([], "candidate_id long")
    assert matching.skill_evidence(world, nobody, REQUEST).count() == 0
    stranger = matching.skill_evidence(world, spark.createDataFrame([(99,)], "candidate_id long"), REQUEST).collect()
    assert {(r["match_type"], r["score"]) for r in stranger} == {("missing", 0.0)}


def test_ladder_on_the_tables(views):
    from hireloom.plans.matches import over_turned, request

    v = over_turned(views)
    people = views.alive.where("candidate_id <= 200").select("candidate_id")
    r = request(views, semantic=True)
    asked = replace(r, required=[" ".join(reversed(n.split(" "))) for n in r.required], preferred=[], mandatory=[])
    skills = [(s["skill_id"], s["name"], s["parent_skill_id"]) for s in v.skill.collect()]
    held: dict = {}
    for x in v.candidate_skill.join(people, "candidate_id", "left_semi").collect():
        held.setdefault(x["candidate_id"], []).append((x["raw_text"], x["skill_id"]))
    ids = {normalize_key_py(n): i for i, n, _ in sorted(skills, key=lambda s: s[0])}
    assert not any(normalize_key_py(n) in ids for n in asked.required)  # so no taxonomy step hides the names
    got = {(x["candidate_id"], x["requested"]): (x["match_type"], x["score"], x["matched_skill"]) for x in matching.skill_evidence(v, people, asked).collect()}
    want = {(p["candidate_id"], n): plain(held.get(p["candidate_id"], []), (n, None), skills) for p in people.collect() for n in asked.required}
    assert got == want
    assert sum(kind == "semantic" for kind, *_ in got.values()) > 0
