import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from hireloom.llm import exact_dedup, ngram_join
from hireloom.llm._shared import Scratch
from hireloom.llm.components import connected_components


def test_runs_merge_like_a_dictionary():
    rng = np.random.default_rng(1)
    keys = [hashlib.sha256(bytes([k])).digest() for k in range(60)]
    rows = [(keys[rng.integers(60)], int(rng.integers(1000))) for _ in range(900)]
    runs = [exact_dedup.flush(np.array([k for k, _ in part], "S32"), np.array([i for _, i in part])) for part in (rows[i : i + 70] for i in range(0, 900, 70))]
    done = exact_dedup.compact(runs)
    least, count = {}, Counter(k for k, _ in rows)
    for k, i in rows:
        least[k] = min(i, least.get(k, i))
    raw = done.digests.tobytes()
    got = {raw[32 * j : 32 * j + 32]: (int(i), int(c)) for j, (i, c) in enumerate(zip(done.idents, done.counts))}
    assert got == {k: (least[k], count[k]) for k in least}
    assert exact_dedup.may_contain(done.filter, done.digests).all()


def test_exact_duplicates(spark, docs, corpus, empty):
    got = exact_dedup.exact_duplicates(spark, docs).collect()
    groups = defaultdict(list)
    for i, text, *_ in corpus:
        groups[text or ""].append(i)
    assert len(got) == len(corpus)
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_hash[r["text_sha256"]]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids) and r["keep_id"] == max(known, default=None)
    assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(by_hash.keys())
    kept = exact_dedup.drop_exact_duplicates(spark, docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(spark, empty).count() == 0 == exact_dedup.drop_exact_duplicates(spark, empty).count()


def test_ids_at_both_ends_nulls_and_clashing_names(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "a"), (high, "b"), (low, "c"), (3, "c"), (high, "d"), (4, "d"), (None, "e"), (low, "e"), (None, "f"), (None, "f"), (9, "g"), (9, "g"), (None, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(c).alias(c) for c in ("__digest", "__ident", "digest", "ident", "keep", "key", "n", "task", "doc", "a.b")])
    docs = docs.repartition(3)
    for keep, pick in (("largest", max), ("smallest", min)):
        groups = defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        want = Counter()
        stays = {t: pick([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
        for i, t in rows:
            want[(i, stays[t or ""], len(groups[t or ""]))] += 1
        got = exact_dedup.exact_duplicates(spark, docs, keep).collect()
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
        assert Counter(r["text_sha256"] for r in got if r["kept"]) == Counter(hashlib.sha256(t.encode()).hexdigest() for t in groups)
        assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
        kept = exact_dedup.drop_exact_duplicates(spark, docs, keep)
        assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"] or "") for r in kept.collect()) == Counter((i, t) for t, i in stays.items())
        assert all(r["__digest"] == "__digest" and r["keep"] == "keep" for r in kept.collect())


def test_smallest_id_can_stay(spark, docs):
    rows = exact_dedup.exact_duplicates(spark, docs, keep="smallest").where("doc_id between 75 and 84").collect()
    assert {r["keep_id"] for r in rows} == {75}


def brute_components(corpus, k=5, percent=75):
    sets, ids = [], []
    for i, text, *_ in corpus:
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
        ids.append(i)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    comps = defaultdict(list)
    for x in range(len(sets)):
        comps[root(x)].append(ids[x])
    out = Counter()
    for x, s in enumerate(sets):
        out[(ids[x], len(s), min((i for i in comps[root(x)] if i is not None), default=None))] += 1
    return out


def test_near_duplicates_equal_brute_force(spark, docs, corpus, empty):
    got = ngram_join.near_duplicates(spark, docs, order_bits=16)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(corpus)
    assert ngram_join.near_duplicates(spark, empty, order_bits=16).count() == 0


def test_split_lists_lose_no_link(spark, docs, corpus, monkeypatch):
    """With a tiny bound every list is split into parts, tied by their heads."""
    monkeypatch.setattr(ngram_join, "HOT", 3)
    monkeypatch.setattr(ngram_join, "NEAREST", 1)
    got = ngram_join.near_duplicates(spark, docs, order_bits=8)
    assert Counter(tuple(r) for r in got.collect()) == brute_components(corpus)


def test_a_group_of_many_classes_is_split(spark, monkeypatch):
    """Sets that share prefix and size are one group; with a tiny bound it is dealt to many parts and loses no link."""
    from itertools import combinations

    passage = lambda name, n: [f"{name}{i}" for i in range(n)]
    gap = passage("gap", 8)
    often = [passage(f"often{k}x", 12) for k in range(7)]
    shared = passage("shared", 26)
    rows = []
    for i, chosen in enumerate(combinations(range(7), 3)):
        words = shared + gap
        for k in chosen:
            words = words + often[k] + gap
        rows.append((i, " ".join(words)))
    for i in range(60):  # these make the passages commoner than what the group shares
        rows.append((100 + i, " ".join(passage(f"own{i}x", 200) + gap + [w for o in often for w in o + gap])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_components(rows)
    for hot, nearest in ((4, 1), (ngram_join.HOT, ngram_join.NEAREST)):
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "NEAREST", nearest)
        assert Counter(tuple(r) for r in ngram_join.near_duplicates(spark, docs, order_bits=16).collect()) == want


def test_rows_and_not_ids_are_kept(spark):
    """Null ids, an id with two texts, repeated rows and clashing names: one row of each component stays."""
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(None, one), (None, one + " x"), (7, two), (7, "alone in the world it is"), (8, two + " y"), (9, "same row"), (9, "same row"), (9, "same row"), (None, None), (3, "")]
    names = ["__id", "__drop", "__bucket", "row_key", "root", "doc", "n", "part", "a.b"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[ngram_join.F.lit(k).alias(c) for k, c in enumerate(names)])
    kept = ngram_join.drop_near_duplicates(spark, docs.repartition(3))
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert all(tuple(r)[2:] == tuple(range(len(names))) for r in kept.collect())
    assert got.pop((None, one), 0) + got.pop((None, one + " x"), 0) == 1
    assert got == {(7, two): 1, (7, "alone in the world it is"): 1, (9, "same row"): 1, (None, None): 1, (3, ""): 1}


def test_wide_bitmaps_bound_the_difference():
    rng = np.random.default_rng(5)
    pool = np.unique(rng.integers(0, 1 << 63, 9_000).astype(np.uint64))
    for n, m, shared in ((1_025, 1_300, 1_000), (1_500, 2_049, 1_400), (5_000, 6_000, 4_800), (3_000, 3_000, 0), (4_000, 4_000, 4_000)):
        x, y = pool[:n], pool[n - shared : n - shared + m]
        apart = n + m - 2 * shared
        found = ngram_join.differing(ngram_join.wide_parity(x), ngram_join.wide_parity(y))
        assert found <= apart and (found == 0) == (apart == 0)
    assert not ngram_join.may_link(3_000, 3_000, ngram_join.differing(ngram_join.wide_parity(pool[:3_000]), ngram_join.wide_parity(pool[3_000:6_000])), 75)
    assert ngram_join.wide_parity(pool[:1_024]) is None


def test_long_near_copies_link(spark):
    """Long texts that share passages only are told apart by their wide bitmaps; near copies stay linked."""
    words = [f"w{i}" for i in np.random.default_rng(6).integers(0, 50_000, 12_000)]
    base, passage = words[:2_500], words[2_500:2_800]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:2_450], *words[3_000:3_040]])), (3, None)]
    rows += [(10 + i, " ".join([*passage, *words[3_100 + 1_500 * i : 4_600 + 1_500 * i]])) for i in range(5)]
    corpus = [(i, t) for i, t in rows]
    got = ngram_join.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), order_bits=16)
    want = brute_components(corpus)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert len({c for _, _, c in want}) == 7


def test_near_duplicates_keep_one(spark, docs, corpus):
    kept = ngram_join.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns
    want = brute_components(corpus)
    words = {c for (i, n, c) in want if n and c is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i in words) == sorted(words)
    assert {85, 86, 87} <= set(ids)


def test_shingles_tell_short_texts_apart():
    one, two, none, longer = ngram_join.shingle_sets(["One two", "one  TWO", " \n", "one two three four five six"])
    assert one.tolist() == two.tolist() and len(none) == 0 and len(longer) == 2


def test_components(spark):
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(1, 40)] + [(b"z", b"y"), (b"q", b"q")], "a binary, b binary").repartition(4)
    import hireloom.llm.components as c

    for chunk in (c.CHUNK, 7):
        c.CHUNK, before = chunk, c.CHUNK
        got = {bytes(r["node"]): bytes(r["root"]) for r in connected_components(Scratch(spark, "t"), edges).collect()}
        c.CHUNK = before
        assert got == {bytes([i]): bytes([1]) for i in range(1, 41)} | {b"y": b"y", b"z": b"y"}
