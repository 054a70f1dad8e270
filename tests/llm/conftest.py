import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, shard string"


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls in any column, empty and long texts, ties, repeats, copies and near copies."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        rows.append((i, make(rng.randint(3, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None])))
    base = make(80).split()
    for i in range(60, 75):  # near copies of one text
        copy = list(base)
        copy[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(copy), "en", "a"))
    rows += [(i, "Same text, same bytes.", "en", "b") for i in range(75, 85)]
    rows += [(85, None, None, None), (86, "", "en", "c"), (87, " \t\n", None, "a"), (88, "one", "en", "a"), (89, "ONE", "de", "b")]
    rows += [(90, make(9000), "en", "c"), (91, "x" * 5000, "en", "c"), (92, "Größe été 漢字 🙂   end", "de", "a")]
    rows += [(5, rows[5][1], rows[5][2], rows[5][3]), (None, "no id here at all today", "en", "a"), (None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    full = [(*r, len(r[1]) if r[1] else None, "clash", "clash", None) for r in corpus]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
