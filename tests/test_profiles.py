"""Records, files and streams against plain versions."""

import datetime
import io
import zipfile
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hireloom.functions import text, vectors
from hireloom.operators import access, extract, graph, profiles, taxonomy
from hireloom.sources import files, skills_csv
from hireloom.streaming import events as ev


def plain_embedding(value, dim=384):
    import hashlib

    tokens, key = text.tokenize_py(value or ""), text.normalize_key_py(value)[:4000]
    features = [("w:" + t, 1.0) for t in tokens] + [(f"b:{a}_{b}", 0.7) for a, b in zip(tokens, tokens[1:])] + [("c:" + key[i : i + 3], 0.35) for i in range(len(key) - 2)]
    out = np.zeros(dim)
    for name, weight in features:
        v = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
        out[v % dim] += weight if v >> 63 else -weight
    out = np.sign(out) * np.log1p(np.abs(out))
    return out / (np.linalg.norm(out) or 1)


def test_embeddings_equal_plain_ones(spark):
    rows = ["Python and Spark", "Node.js, C++ and SQL. " * 300, None, "", "ab", "é漢字🙂 x", "C# C# C#"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i long, t string").select("i", vectors.hash_embedding("t").alias("v")).orderBy("i").collect()
    for r, t in zip(got, rows):
        assert np.allclose(r["v"], plain_embedding(t), atol=1e-6)
    known = vectors.embed_py("Python and Spark")
    assert np.flatnonzero(known)[:10].tolist() == [49, 56, 79, 100, 125, 134, 157, 186, 221, 241]
    assert np.allclose(known[np.flatnonzero(known)][:4], [0.1927, 0.1927, 0.1927, 0.3408], atol=1e-4)


def test_csv_with_separator_line_and_aliases(spark, tmp_path):
    one = '﻿sep=;\n\ncode;SkillName;tech_stack;role;alias;definition\n1;Python;Backend;Developer|Analyst;py,python3;"two\nlines; and ""more"""\n2;;x;;;\n'
    (tmp_path / "a.csv").write_bytes(one.encode())
    (tmp_path / "b.csv").write_text("skill_name,category,parent\nDjango,web framework,Python\n")
    rows = {r["skill_name"]: r for r in skills_csv.read(spark, f"file://{tmp_path}").collect()}
    assert set(rows) == {"Python", "Django"}
    p = rows["Python"]
    assert (p["skill_id"], p["technology_stack"], p["job_role"], p["skill_synonyms"]) == ("1", "Backend", ["Developer", "Analyst"], ["py", "python3"])
    assert p["skill_description"] == 'two\nlines; and "more"' and rows["Django"]["parent_skill"] == "Python" and rows["Django"]["category"] == "Web Framework"
    (tmp_path / "bad").mkdir()
    for content in (b"PK\x03\x04zip", b"{}", b"", b"name;category\nx;y\n"):
        (tmp_path / "bad" / "c.csv").write_bytes(content)
        with pytest.raises(ValueError):
            skills_csv.read(spark, f"file://{tmp_path}/bad").count()


def test_csv_written_as_one_file_with_mark(spark, tmp_path):
    rows = skills_csv.parse_rows(spark.createDataFrame([("C++", 'a "b", c', "x;X;y")], "skill_name string, skill_description string, related string"))
    skills_csv.write(rows, f"file://{tmp_path}/out")
    parts = list((tmp_path / "out").glob("*.csv"))
    assert len(parts) == 1
    lines = parts[0].read_text(encoding="utf-8").splitlines()
    assert lines[0] == "﻿" + ",".join(skills_csv.COLUMNS) and lines[1] == ',C++,,,x;y,,,,,"a ""b"", c"'


def test_slugs_are_unique(spark):
    names = ["C", "C#", "C++", "c!", "Java", "java"]
    rows = spark.createDataFrame([(n,) for n in names], "skill_name string").withColumn("key", F.concat(F.lit("k"), "skill_name"))
    got = {r["key"][1:]: r["slug"] for r in skills_csv.unique_slugs(rows).collect()}
    assert len(set(got.values())) == len(names) and got["C"] == "c" and got["C#"] == "c-csharp" and got["C++"] == "c-cplusplus"


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return held.getvalue()


def test_document_files(spark, tmp_path):
    given = {"a.docx": docx("Alex", "SKILLS"), "b b!.txt": b"\xef\xbb\xbfplain \xff text", "c.pdf": b"%PDF-1.4 x", "d.exe": b"MZ", "e.pdf": b"no pdf", "f.md": b"", "g.docx": b"PK\x03\x04broken"}
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r for r in files.read(spark, f"file://{tmp_path}").collect()}
    assert got["a.docx"]["text"] == "Alex\nSKILLS" and got["a.docx"]["kind"] == "docx" and got["a.docx"]["pages"] == 1
    assert got["b_b_.txt"]["text"] == "plain  text" and got["c.pdf"]["warning"] == "no reader for pdf" and got["g.docx"]["warning"] == "no reader for docx"
    assert [got[n]["refused"] for n in ("d.exe", "e.pdf")] == ["ending", "signature"] and "f.md" not in got


def test_fuzzy_blocks_lose_no_pair(spark):
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcde"), rng.integers(4, 14))) for _ in range(120)]
    asked = []
    for n in names:
        cut = int(rng.integers(len(n)))
        asked.append(n[:cut] + rng.choice(list("abcde")) + n[cut + int(rng.integers(2)) :])
    skills = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "skill_id long, name string")
    synonyms = spark.createDataFrame([], "skill_id long, synonym string")
    got = {r["phrase"]: (r["skill_id"], r["match_type"]) for r in taxonomy.resolve(spark.createDataFrame([(a,) for a in asked], "phrase string"), skills, synonyms).collect()}
    by_key = {n: max(i for i, m in enumerate(names) if m == n) for n in names}
    for a in set(asked):
        if a in by_key:
            assert got[a] == (by_key[a], "exact")
            continue
        best = sorted((-text.similarity_py(a, n), i) for n, i in by_key.items() if abs(len(a) - len(n)) <= 4 and len(a) >= 4)
        want = (best[0][1], "fuzzy") if best and -best[0][0] >= 0.9 else (None, "none")
        assert got[a] == want, a


def test_timed_lockouts_equal_a_loop(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(3)), int(rng.integers(0, 9000)), rng.choice(["error", "view"], p=[0.7, 0.3])) for i in range(500)]
    events = spark.createDataFrame([(a, b, c, str(d)) for a, b, c, d in rows], "event_id long, user_id long, s long, event_type string").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = {}
    for user in range(3):
        fails, until = 0, None
        for i, _, t, kind in sorted((r for r in rows if r[1] == user), key=lambda r: (r[2], r[0])):
            if until is not None and t < until:
                want[i] = "locked"
                continue
            if until is not None:
                fails, until = 0, None
            fails = fails + 1 if kind == "error" else 0
            want[i] = "failed" if kind == "error" else "ok"
            if fails >= 3:
                until = t + 300
    assert {r["event_id"]: r["outcome"] for r in ev.timed_lockouts(events, 3, 5).collect()} == want
    assert "locked" in want.values()


def test_stream_forms(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    rows = [(i, i % 4, "view", datetime.datetime(2024, 1, 1, 0, 0, (i * 7) % 60)) for i in range(120)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = ev.run_available(ev.accepted_stream(stream, 10, 3), "accepted", "append", f"file://{tmp_path}/c1")
    batch = ev.accepted_hits(spark.read.parquet(str(tmp_path / "in")), 10, 3)
    assert {r["event_id"]: r["allowed"] for r in got.collect()} == {r["event_id"]: r["allowed"] for r in batch.collect()}

    def handle(df, batch_id):
        df.write.mode("overwrite").parquet(f"{tmp_path}/done/batch={batch_id}")

    for _ in range(2):  # a second start has nothing new
        ev.ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), handle, f"file://{tmp_path}/c2")
    assert spark.read.parquet(str(tmp_path / "done")).count() == 120


def test_audit_grows(spark, tmp_path):
    rows = spark.createDataFrame([("login", 1, "user", "2024-01-01")], "action string, user_id long, entity string, created_at string")
    for _ in range(2):
        access.append_audit(rows, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_new_persons_are_tied_through_mail_and_phone(spark):
    rows = [(1, None, "a", "1"), (2, None, "a", "2"), (3, None, "b", "2"), (4, None, None, "9"), (5, None, None, None), (6, 77, "a", "1")]
    found = spark.createDataFrame(rows, "resume_id long, candidate_id long, mail string, number string")
    assert {r["resume_id"]: r["person"] for r in profiles.new_person_groups(found).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_properties_keep_known_values(spark):
    rows = spark.createDataFrame([("k", 1, {"a": "1", "b": None}), ("k", 2, {"a": None, "b": "2"}), ("k", 3, {"b": "3"})], "key string, seq int, properties map<string,string>")
    assert graph.merge_properties(rows).first()["properties"] == {"a": "1", "b": "3"}
    assert graph.first_properties(rows).first()["properties"] == {"a": "1", "b": "2"}


def test_degrees_and_spans(spark):
    given = {"Ph.D in Physics": "PhD", "B. Tech, CSE": "B.Tech", "Master of Science": "M.Sc", "B.E. 2010": "B.E.", "MBA": "MBA", "High School": "High School", "12th": "High School", "nothing here": None}
    rows = spark.createDataFrame([(t,) for t in given], "t string").select("t", extract.degree_rank(F.col("t"), 0).alias("d")).collect()
    assert {r["t"]: r["d"] for r in rows} == given
    lines = ["Jan 2018 - Present", "03/2016 – 2017-12", "2010 to 2014", "Sept. 2019 until Mar 2020"]
    marked = spark.createDataFrame([(t,) for t in lines], "t string").select(extract.mark_dates(F.col("t")).alias("m"))
    got = [tuple(r) for r in marked.select(extract.date_of(extract.group(F.col("m"), extract.SPAN, 1)), extract.date_of(extract.group(F.col("m"), extract.SPAN, 2), end=True)).collect()]
    d = datetime.date
    assert got == [(d(2018, 1, 1), None), (d(2016, 3, 1), d(2017, 12, 31)), (d(2010, 1, 1), d(2014, 12, 31)), (d(2019, 9, 1), d(2020, 3, 31))]


def test_requirement_names(spark):
    rows = [('["a", {"skill": "b"}, {"name": "c"}, {"x": 1}]',), ("[]",), ("no json",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").select(access.names_of(F.col("j"))).collect()]
    assert got[0] == ["a", "b", "c"] and got[1:] == [[], [], []]


def test_merged_months(spark):
    spans = [[("2020-01-05", "2020-03-01"), ("2020-02-01", "2020-06-30"), ("2021-01-01", "2021-01-31")], [], [("2020-05-01", "2020-05-02")]]
    want = []
    for own in spans:
        covered = defaultdict(int)
        for a, b in own:
            for m in range(int(a[:4]) * 12 + int(a[5:7]), int(b[:4]) * 12 + int(b[5:7]) + 1):
                covered[m] = 1
        want.append(len(covered))
    df = spark.createDataFrame([(s,) for s in spans], "s array<struct<start:string,end:string>>")
    typed = F.transform("s", lambda x: F.struct(x["start"].cast("date").alias("start"), x["end"].cast("date").alias("end")))
    assert [r[0] for r in df.select(extract.merged_months(typed)).collect()] == want


def test_a_chain_of_new_persons_is_one(spark):
    rows = [(i, f"m{i // 2}", f"n{(i + 1) // 2}") for i in range(1, 301)]  # mails and phones tie neighbours in turn
    rows += [(500, None, None), (501, "x", None), (502, "x", None), (503, None, "y")]
    found = spark.createDataFrame([(None, *r) for r in rows], "candidate_id long, resume_id long, mail string, number string").repartition(4)
    got = {r["resume_id"]: r["person"] for r in profiles.new_person_groups(found).collect()}
    assert got == {i: 1 for i in range(1, 301)} | {500: 500, 501: 501, 502: 501, 503: 503}


def test_a_record_is_parsed_once(spark, views):
    """The plans of queries on parsed records name the certificates' (or the jobs') expressions once."""
    from hireloom.plans import profiles as plans

    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        shown = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        told = "(?i)certifi"
        once = shown(plans.parsed(views).select("resume.certifications")).count(told)
        assert once == shown(plans.candidate_highlights(views)).count(told) == shown(plans.resume_completeness(views)).count(told) == shown(plans.resume_certification_rows(views)).count(told) >= 1
        assert "size(_extract" not in shown(plans.resume_experience_rows(views))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_resumes_without_keys_are_spread(spark):
    """Rows that lack a link, a mail or a phone don't meet in one partition of the joins."""
    own = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, value in own.items():
            spark.conf.set(k, value)
        made = "id as resume_id", "if(id < 0, id, null) as linked_id", "if(id < 0, 'a@x.org', null) as email", "if(id < 0, '5550000001', null) as phone"
        people = spark.range(5).selectExpr("id as candidate_id", "concat('p', id, '@x.org') as email", "cast(5550000000 + id as string) as phone", "false as is_deleted")
        found = profiles.find_person(spark.range(800).selectExpr(*made), people)
        sizes = [len(x) for x in found.rdd.glom().collect()]
        assert sum(sizes) == 800 and max(sizes) < 200
    finally:
        for k, value in before.items():
            spark.conf.set(k, value)
