"""Phrase mining and hard negatives against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hireloom.llm.collocations import mine_phrases
from hireloom.llm.hard_negatives import hard_negatives


def plain_phrases(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    cand = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = []
    for (lang, p), a in cand.items():
        around = [q for (other, q), b in cand.items() if other == lang and len(q) > len(p) and b >= a]
        if any(q[i : i + len(p)] == p for q in around for i in range(len(q) - len(p) + 1)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i, *o[1:]) for i, o in enumerate(mine, 1)]
    return sorted(ranked)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["the", "Of", "is", "a\x01", "a", "é", "x-y", "Ünï"]
    rows = []
    for _ in range(150):
        body = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randrange(40)))
        rows.append((body, rng.choice(["en", "de", None, "und"])))
    rows += [("new york city " * 30, "en"), (None, "en"), ("", None), (" \t.,;", "de"), ("go go go go go " * 2000, "en")]
    return rows + rows[:20]


def test_phrases_equal_plain_counts(spark, texts):
    df = spark.createDataFrame([(t, g, "clash", 1) for t, g in texts], "text string, lang string, words string, f int").repartition(5)
    for least, top in ((5, 2000), (12, 3)):
        assert sorted(map(tuple, mine_phrases(spark, df, least=least, top=top).collect())) == plain_phrases(texts, least, top)


def test_phrases_of_nothing(spark):
    assert mine_phrases(spark, spark.createDataFrame([], "text string, lang string")).count() == 0


def plain_negatives(rows, every=100):
    held = []
    for vec_id, x, label in rows:
        if None in (vec_id, x, label) or any(v is None or not math.isfinite(v) for v in x):
            continue
        held.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * v) for v in x]))
    out = []
    for ai, (a, la, qa) in enumerate(held):
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(qa, qb)), b, lb) for bi, (b, lb, qb) in enumerate(held) if bi != ai)
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            fits = [s for s in scored if s[2] != la and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:5]
            out += [(a, p, i, b, -ps, -s) for i, (s, b, _) in enumerate(fits, 1)]
    return sorted(out)


def test_hard_negatives_equal_plain(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5, rng.random()]) for _ in range(7)], rng.randrange(10)) for i in range(330)]
    rows += [(1000 + i, rows[10][1], rng.randrange(3)) for i in range(120)]  # many copies of one vector
    rows += [(2000, None, 1), (None, [0.1] * 7, 1), (2100, [0.1] * 7, None), (2200, [None] + [0.1] * 6, 1), (2300, [float("nan")] * 7, 2), (2400, [float("inf")] * 7, 2), (2500, [], 3), (2600, [0.5] * 3, 4)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, label int, spot string").repartition(4)
    want = plain_negatives([(i, x and [None if v is None else float(np.float32(v)) for v in x], g) for i, x, g in rows])
    assert want
    for tiles in ({}, {"anchors_per_tile": 3, "rows_per_tile": 50, "width": 3}):
        assert sorted(map(tuple, hard_negatives(spark, df, **tiles).collect())) == want


def test_hard_negatives_of_nothing(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert hard_negatives(spark, spark.createDataFrame([], schema)).count() == 0
    assert hard_negatives(spark, spark.createDataFrame([(100, [1.0], 1)], schema)).count() == 0
    assert hard_negatives(spark, spark.createDataFrame([(1, [1.0], 1)], schema)).count() == 0
