"""Cases of the third round: values, sizes and plans that the small tables don't show."""

import tracemalloc
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hireloom.functions import text, vectors
from hireloom.llm import huffman, language_id, secrets, tokens
from hireloom.operators import documents, profiles, taxonomy, vector_search
from hireloom.plans import registry
from tests.conftest import DATA


@pytest.mark.parametrize("name", ["candidate_document", "candidate_embedding_texts"])
def test_negative_zero_years_as_in_sql(spark, tmp_path, name):
    for p in Path(DATA).glob("*.parquet"):
        if p.stem != "customer":
            (tmp_path / p.name).symlink_to(p)
    c = duckdb.connect()
    c.sql(f"""copy (select * replace (case c_custkey % 4 when 1 then '-0.0'::double when 2 then 0 when 3 then null else c_acctbal end as c_acctbal)
        from '{DATA}/customer.parquet') to '{tmp_path}/customer.parquet'""")
    for p in tmp_path.glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    df = registry.queries()[name](spark, str(tmp_path))
    want = c.sql(registry.oracle_sql()[name])
    assert sorted(map(tuple, df.select(*want.columns).collect())) == sorted(want.fetchall())


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_vectors_are_made_once(spark):
    rows = spark.createDataFrame([(1, "profile", 0, "Spark and SQL"), (2, "profile", 0, "")], "candidate_id long, kind string, chunk_index int, text string")
    kept = profiles.embed_rows(rows)
    assert plan(kept).count("EvalPython") == 1 and [r["candidate_id"] for r in kept.collect()] == [1]
    asked = rows.select(F.col("candidate_id").alias("embedding_id"), "kind", "candidate_id", vectors.hash_embedding("text").alias("vector"))
    found = vector_search.top_k(asked, vectors.embed_py("SQL").tolist(), 2)
    assert plan(found).count("EvalPython") == 1 and found.first()["embedding_id"] == 1


def test_start_of_a_key_is_that_of_the_whole():
    for value in ("a " * 50, "ΑΣ ΑΣ " * 20, "ΟΔΟΣ" * 30, "é " * 40 + "x", "", None, "no_space_" * 20, " . " * 40 + "end"):
        for chars in (1, 5, 20, 70):
            assert text.key_start(value, chars) == text.normalize_key_py(value)[:chars]


def test_texts_leave_their_batch_a_few_at_a_time():
    held = []
    texts = ["• É & b"] * 1000 + [None, ""]
    for make, want in ((text.normalize_key_py, "eandb"), (text.clean_text_py, "É & b")):
        got = text.each_text(pa.array(texts), lambda t, make=make: held.append(t) or make(t)).to_pylist()
        assert got == [want] * 1000 + ["", ""] and len(held) == len(texts)
        held.clear()
    assert text.each_text(pa.array([], pa.string()), text.clean_text_py).to_pylist() == []


def test_scan_normalizes_tokens_and_not_runs(spark):
    docs = spark.createDataFrame([(1, "Uses Node.js, C++ and power bi.\nPower  BI; ..C# & É .NET"), (2, None)], "doc_id long, text string")
    skills = spark.createDataFrame([(i, n) for i, n in enumerate(["NodeJS", "C++", "Power BI", "C#", ".NET", "R&D"])], "skill_id long, name string")
    found = taxonomy.scan_text(docs, skills)
    assert {(r["skill_id"], r["line_no"], r["mentions"]) for r in found.collect()} == {(0, 0, 1), (1, 0, 1), (2, 0, 2), (3, 1, 1), (4, 1, 1)}
    # Before, a regular expression ran over every run of tokens, after they were taken apart.
    assert "gram#" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_only_named_fields_are_parsed_and_texts_move_once(spark, views):
    """The plan of a query on few fields holds no others, cleans a text once, and doesn't shuffle lines."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        shown = plan(registry.load()["resume_projects_languages"].plan(views))
        assert "linkedin.com/pub" not in shown and "ongoing" in shown
        assert shown.count("ArrowEvalPython") == 1 and "Window" not in shown
        assert "linkedin.com/pub" not in plan(registry.load()["parse_resumes"].plan(views))
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_lines_under_their_headers(spark):
    resume = "Ann Lee\n\n  \nSkills: Python, SQL\nSpark\nLanguages\nProjects:\n one: two\nEDUCATION\n"
    docs = spark.createDataFrame([(1, resume), (2, None), (3, ""), (4, "Skills"), (5, "Skills:\n\nSkills: a\nno end")], "doc_id long, text string")
    got = {}
    for r in sorted(documents.section_lines(docs).collect(), key=lambda r: (r["doc_id"], r["pos"])):
        got.setdefault(r["doc_id"], []).append((r["pos"], r["section"], r["line"]))
    assert got == {
        1: [(0, "header", "Ann Lee"), (3, "skills", "Python, SQL"), (4, "skills", "Spark"), (7, "projects", " one: two")],
        5: [(2, "skills", "a"), (3, "skills", "no end")],
    }


def test_ids_are_counted_many_documents_at_a_time():
    documents = [(3, np.array([1, 5, 5], "<u2").tobytes()), (0, b""), (2, np.array([70_000, 1], "<u4").tobytes())] * 40
    assert [len(x) for x in huffman._together(documents, 90)] == [90, 90, 20]
    batch = pa.RecordBatch.from_arrays([pa.array([n for n, _ in documents]), pa.array([raw for _, raw in documents], pa.binary())], names=["n", "ids"])
    (found,) = huffman._count_ids([batch, batch])
    assert dict(zip(found.column(0).to_pylist(), found.column(1).to_pylist())) == {1: 160, 5: 160, 70_000: 80}
    assert sum(len(b) for b in huffman._count_ids([])) == 0


def test_memo_that_turns_over_within_a_text():
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    whole = enc.encode("one two three four one five six one")
    enc.WORDS = 3
    assert b"".join(enc.encode(t) for t in ("one two three", "four one", "five six one")) == whole


def test_a_plain_search_comes_before_the_pattern(spark):
    """Texts are marked for the sample as by the patterns alone."""
    texts = ["TOKEN = abcdefghijkl", "my Api_Key: ABCDEFGHIJKLMN", "a token, no more", "AKIAABCDEFGHIJKLMN", "AKIA", "x 0123456789abcdef", "plain words", "paſſwd=abcdefghijkl", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = [h for h, *_ in secrets._sample_hits(docs).orderBy("text").collect()]
    assert hits == [bool(secrets.base_spans(t)) for t in sorted(texts) if t]


def test_ids_of_many_texts_at_a_time():
    """op9_token_files, op10_best_fit_packing, pipeline: texts of a batch are encoded together; odd words, empty and long texts as by the library."""
    odd = ["a\x1cb c’s don't l'été d'Été, NAÏVE... foo-bar (x) [y]", "été <|endoftext|> 12,345.6 ß ſ ŉ İ Σ", None, "", " \n ", "'''\x0b's\t", "Word. word\" WORD-- ++ -", "</w> Ġ aĠb"]
    texts = odd + ["many words " * 40] + [f"word{i} Wörd{i}, more." for i in range(30)] + odd
    enc = tokens.WordEncoder(tokens.tokenizer_path())
    want = [enc.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    for enc.SLICE, enc.CORES in ((1 << 22, 300_000), (60, 4), (1, 300_000)):
        found = {}
        for at, ids in enc.encode_all(pa.array([None, *texts])[1:], np.array([2], enc.dtype).tobytes()):
            found.update((at + i, np.frombuffer(x, enc.dtype).tolist()) for i, x in enumerate(ids.to_pylist()))
        assert [found[i] for i in range(len(texts))] == want
    assert not list(enc.encode_all(pa.array([], pa.string())))


def test_language_is_scored_in_small_steps():
    """pipeline, op3_language_id: every core's worker holds the numbers of a step, so a step is small."""
    grams = np.random.default_rng(1).integers(97, 123, (2_000, 4)).astype(np.uint32)
    found = language_id.Identifier({"a": language_id.KneserNey(grams, np.ones(2_000), 26)})
    texts = ["some words of a text " * 100] * 600
    few = found.predict(texts[:2])
    tracemalloc.start()
    every = found.predict(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15e6
    assert every["bits"].tolist() == [few["bits"][0]] * 600
