import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from hireloom.llm import language_id, lm_score, mixing, quality
from tests.conftest import DATA


def test_kneser_ney_sums_to_one():
    columns, _ = language_id._windows(*language_id.letters(["abracadabra abc", "bananas and cabs"]))
    grams, counts = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    alphabet = len(np.unique(grams[:, -1]))
    model = language_id.KneserNey(grams, counts.astype(float), alphabet)
    letters = np.append(np.unique(grams[:, -1]), 0x4E00).astype(np.uint32)  # and one that was never seen
    for context in ("abr", "zzz", " an"):
        before = [np.full(len(letters), ord(c), np.uint32) for c in context]
        assert abs(model.probability([*before, letters]).sum() - 1) < 1e-9


def test_memo_changes_nothing():
    texts = ["the cat sat on the mat " * 20, "die katze sitzt auf der matte " * 20, None, "123", "x"]
    columns, doc = language_id._windows(*language_id.letters(texts[:2]))
    models = {}
    for i, lang in enumerate(("en", "de")):
        grams, counts = np.unique(np.stack([c[doc == i] for c in columns], 1), axis=0, return_counts=True)
        models[lang] = language_id.KneserNey(grams, counts.astype(float), 30)
    found = language_id.Identifier(models)
    once, twice = found.predict(texts), found.predict(texts)
    assert once.equals(twice)
    assert once["lang_pred"].tolist()[:2] == ["en", "de"] and once["lang_pred"].tolist()[2:4] == ["und", "und"]
    assert once["score"].between(0, 1).all() and once["score"].tolist()[2] == 0


def test_language_id_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = language_id.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert not any(r["rejected"] for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_language_id_edges(spark, docs, corpus, empty):
    got = language_id.identify(spark, docs).collect()
    assert len(got) == len(corpus)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r["lang_pred"])
    assert by[85] == by[86] == by[87] == ["und"] and by[90] != ["und"]
    kept = language_id.keep_identified(spark, docs)
    assert kept.columns == docs.columns and 85 not in {r["doc_id"] for r in kept.collect()}
    assert language_id.identify(spark, empty).count() == 0


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    params = {k: v.astype(np.float64) for k, v in lm_score.init_params(9, hidden=3, class_size=4).items()}
    inputs, targets = rng.integers(0, 9, (4, 2)), rng.integers(0, 9, (4, 2))
    fresh = np.zeros((4, 2))
    fresh[2, 1] = 1
    h = rng.standard_normal((2, 3))
    _, g, _ = lm_score.window_gradients(params, inputs, targets, fresh, h)
    for name in ("E", "W", "U", "b", "Wc", "bc", "Ww"):
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in params[name].shape)
            ends = []
            for step in (1e-5, -1e-5):
                params[name][at] += step
                ends.append(lm_score.window_gradients(params, inputs, targets, fresh, h)[0])
                params[name][at] -= step
            assert abs((ends[0] - ends[1]) / 2e-5 - g[name][at]) < 1e-4


def test_documents_score_alike_alone_and_together():
    params = lm_score.init_params(50)
    rng = np.random.default_rng(2)
    ids = [np.append(rng.integers(1, 50, n), 0) for n in (0, 3, 40, 200)]
    together = lm_score.score_documents(params, ids)
    alone = [lm_score.score_documents(params, [x])[0] for x in ids]
    assert np.allclose(together, alone, rtol=1e-4)


def test_scores(spark, docs, corpus, empty):
    got = lm_score.score_texts(spark, docs).collect()
    assert len(got) == len(corpus)
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode())) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t, *_ in corpus if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in corpus:
        own = tokens(t)
        want[(i, held(i), len(own), sum(c[w] > 0 for w in own), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own), 4))] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert lm_score.score_texts(spark, empty).count() == 0


def test_network_beats_counts(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = lm_score.score_texts(spark, docs).where("held_out").collect()
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_quality(spark, docs, empty):
    table = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.score_quality(spark, table, labels).join(labels, "doc_id").collect()
    assert sum(r["keep"] for r in got if r["quality"] == 1) >= 0.97 * sum(r["quality"] for r in got)
    assert sum(r["keep"] == (r["quality"] == 1) for r in got) >= 0.93 * len(got)
    none = labels.limit(0)
    plain = quality.score_quality(spark, docs, none).collect()
    assert len(plain) == docs.count() and {(r["score"], r["keep"]) for r in plain} == {(0.5, True)}
    assert quality.score_quality(spark, empty, labels).count() == 0


def test_quality_of_documents_never_seen(spark):
    """Accuracy on labels of the held-out fold only, with every tenth training label wrong."""
    table = spark.read.parquet(f"{DATA}/documents.parquet".replace("sf0.001", "sf0.01"))
    labels = spark.read.parquet(f"{DATA}/labels.parquet".replace("sf0.001", "sf0.01"))
    wrong = labels.withColumn("quality", quality.F.expr("case when crc32(cast(doc_id as string)) % 4 != 2 and doc_id % 10 = 3 then 1 - quality else quality end"))
    for given, least in ((labels, 0.95), (wrong, 0.9)):
        got = quality.score_quality(spark, table, given).where("held_out").join(labels, "doc_id").collect()
        good = [r for r in got if r["quality"] == 1]
        assert len(good) > 50 and len(got) - len(good) > 10
        assert sum(r["keep"] for r in good) >= 0.97 * len(good)
        pairs = [(a["score"] > b["score"]) + 0.5 * (a["score"] == b["score"]) for a in good for b in got if b["quality"] == 0]
        assert sum(pairs) / len(pairs) >= least


def test_logistic_equals_plain_descent(spark):
    rng = np.random.default_rng(8)
    x, y = rng.standard_normal((60, 3)), (rng.random(60) < 0.4).astype(float)
    w = quality.logistic(lambda v: x @ v, lambda r: x.T @ r, y, 3, steps=3000, decay=1e-2)
    plain = np.zeros(4)
    both = np.hstack([x, np.ones((60, 1))])
    for _ in range(20_000):
        plain -= 0.1 * (both.T @ (1 / (1 + np.exp(-both @ plain)) - y) / 60 + 1e-2 * plain)
    assert np.allclose(w, plain, atol=1e-2)


def test_surest_equals_a_sort(spark, monkeypatch):
    monkeypatch.setattr(quality, "PER_ROUND", 10)
    rng = np.random.default_rng(9)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(np.round(rng.standard_normal((80, 2)), 1))]
    got = Counter(tuple(r) for r in quality.surest(spark.createDataFrame(rows, "doc_id long, text_logit double, meta_logit double"), 0.3).collect())
    want = Counter()
    for teacher in (0, 1):
        ups = sorted((r for r in rows if r[1 + teacher] > 0), key=lambda r: (-r[1 + teacher], r[0]))[:3]
        downs = sorted((r for r in rows if r[1 + teacher] < 0), key=lambda r: (r[1 + teacher], r[0]))[:7]
        want += Counter([(teacher, 1, r[0]) for r in ups] + [(teacher, 0, r[0]) for r in downs])
    assert got == want


def test_scores_equal_a_plain_network(spark, monkeypatch):
    """Every score again, word by word with plain formulas and the trained weights."""
    trained = []
    whole = lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a, **k: trained.append(whole(*a, **k)) or trained[-1])
    monkeypatch.setattr(lm_score, "VOCAB", 40)
    monkeypatch.setattr(lm_score, "HEAD", 60)
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 3_000)
    rng = np.random.default_rng(12)
    texts = [" ".join(f"W{min(int(x), 150)}" for x in rng.zipf(1.3, n)) for n in rng.integers(0, 60, 60)]
    rows = [(i % 55, t) for i, t in enumerate(texts)] + [(None, None), (None, "never met"), (10, "")]
    got = lm_score.score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    p = {k: v.astype(np.float64) for k, v in trained[0][0].items()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in rows if not held(i) for w in (t or "").lower().split())
    ends = sum(not held(i) for i, _ in rows)
    n, v = sum(c.values()) + ends, len(c) + 1
    top = sorted(c, key=lambda w: (-c[w], w.encode()))[:40]
    mass = ends + 0.1 + sum(c[w] + 0.1 for w in top)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    want = []
    for i, t in rows:
        words = (t or "").lower().split()
        h, last, total, m = np.zeros(24), 0, 0.0, 24
        for w in [*words, None]:
            x, u = p["E"][last] @ p["W"] + p["b"], h @ p["U"]
            z, r = sigmoid(x[:m] + u[:m]), sigmoid(x[m : 2 * m] + u[m : 2 * m])
            h = z * h + (1 - z) * np.tanh(x[2 * m :] + r * u[2 * m :])
            k = 0 if w is None else top.index(w) + 2 if w in top else 1
            a, b = divmod(k, lm_score.CLASS_SIZE)
            logc, logw = h @ p["Wc"] + p["bc"], p["Ww"][a] @ h + p["bw"][a]
            total += logc[a] - np.log(np.exp(logc).sum()) + logw[b] - np.log(np.exp(logw).sum())
            if k == 1:
                total += np.log((c[w] + 0.1) / (n + 0.1 * (v + 1) - mass))
            last = k
        want.append((repr(i), len(words) + 1, total / np.log(10)))
    got = sorted((repr(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    for g, w in zip(got, sorted(want)):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-3 * (1 + abs(w[2])), (g, w)


def test_targets_share_by_weight(spark):
    rows = [("a", 100, 1), ("b", 100, 1), ("c", 1000, 1), (None, 10, 1)]
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark, spark.createDataFrame(rows, "source string, source_size long, docs long")).collect()}
    # a: 5/13 of 1210 is over 300; so are b and the last once more is dealt to them.
    assert got["a"] == 300 and got["b"] == 300 and got[None] == 30 and abs(got["c"] - 580) < 1e-6


def test_settling_keeps_words_and_expectation():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 50, 40).astype(float)
    share = rng.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out = mixing.settle(share, size, rng.random(40))
        assert ((out > 0) & (out < 1)).sum() <= 1 and abs((out * size).sum() - (share * size).sum()) < 1e-6
        total += out
    assert np.abs(total / 3000 - share).max() < 0.06


def test_mix(spark, docs, corpus, empty, monkeypatch):
    plan = mixing.mix_sources(spark, docs).collect()
    monkeypatch.setattr(mixing, "GROUP", 8)
    monkeypatch.setattr(mixing, "FAN_IN", 2)
    tree = mixing.mix_sources(spark, docs).collect()
    again = mixing.mix_sources(spark, docs).collect()
    assert sorted(map(repr, tree)) == sorted(map(repr, again))
    size = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    for got in (plan, tree):
        assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, size(t)) for i, t, *_ in corpus)
        assert all(r["taken"] <= 3 * r["size"] for r in got)
        taken, largest = Counter(), Counter()
        for r in got:
            taken[r["target"]] += r["taken"]
            largest[r["target"]] = max(largest[r["target"]], r["size"])
        assert all(abs(taken[t] - t) < largest[t] for t in taken)
    mixed = mixing.take_mix(spark, docs)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in again:
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want
    assert mixing.mix_sources(spark, empty).count() == 0 == mixing.take_mix(spark, empty).count()


def test_small_sources_come_as_near_as_they_can(spark):
    """Of a few documents the mix takes a set whose sum is the best that floors and ceilings reach; of more, nearly."""
    from itertools import product

    rng = np.random.default_rng(11)
    for seed in range(40):
        size = rng.integers(1, 900, 9).astype(float)
        share = np.full(9, rng.uniform(0.05, 0.95))
        want = (share * size).sum()
        out = mixing.absorb(mixing.settle(share, size, rng.random(9)), size, rng.random(9))
        best = min(abs(sum(a * b for a, b in zip(bits, size)) - want) for bits in product((0, 1), repeat=9))
        assert set(out) <= {0.0, 1.0} and abs(abs((out * size).sum() - want) - best) < 1e-6
    for n in (17, 60, 400):
        size = rng.integers(1, 20_000, n).astype(float)
        share = np.full(n, 0.37)
        out = mixing.absorb(mixing.settle(share, size, rng.random(n)), size, rng.random(n))
        assert abs((out * size).sum() - (share * size).sum()) < 2
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    by = defaultdict(list)
    for r in mixing.mix_sources(spark, docs).join(docs.select("doc_id", "source"), "doc_id").collect():
        by[r["source"]].append(r)
    for rows in by.values():
        target, rate = rows[0]["target"], rows[0]["target"] / rows[0]["source_size"]
        sums = np.zeros(1)
        for r in rows:  # all that whole copies and one more can reach
            sums = np.unique(np.concatenate([sums + r["size"] * int(rate), sums + r["size"] * math.ceil(rate)]))
        assert abs(abs(sum(r["taken"] for r in rows) - target) - np.abs(sums - target).min()) < 1e-6


def test_mix_carries_clashing_names_and_repeats(spark):
    names = ["__id", "__key", "__source", "__copies", "copies", "id", "of", "nth", "times", "doc", "a.b"]
    rows = [(i, " ".join(["w"] * (i + 1)), "a" if i % 3 else None) for i in range(12)] + [(4, "w w w w w", "a")] * 3 + [(None, "x y", "b")] * 2 + [(50, None, "b"), (51, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *[mixing.F.lit(c).alias(c) for c in names])
    mixed = mixing.take_mix(spark, docs.repartition(3))
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix_sources(spark, docs).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    got = mixed.collect()
    assert Counter((r["doc_id"], len((r["text"] or "").split())) for r in got) == +want
    assert all(list(r)[3:] == names for r in got)


def test_network_trains_on_every_token_once(spark, docs, corpus, monkeypatch):
    seen = []
    whole = lm_score.train

    def spy(*args, **kwargs):
        seen.append(whole(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(lm_score, "train", spy)
    tokens = lm_score.score_texts(spark, docs).first()["train_tokens"]
    assert seen[0][1] == tokens


def test_last_tokens_of_a_task_are_learned():
    params = lm_score.init_params(9, hidden=3, class_size=4)
    docs = [np.array([2, 3, 4] * 30 + [5, 0])]  # 92 tokens in 5 streams
    found, tokens = lm_score.train_on(params, docs)
    other, _ = lm_score.train_on(params, [np.array([2, 3, 4] * 30 + [5, 6])])
    assert tokens == 92 and not np.allclose(found["bw"], other["bw"])


def test_filled_places_count_for_nothing():
    rng = np.random.default_rng(1)
    params = lm_score.init_params(9, hidden=3, class_size=4)
    inputs, targets, fresh = rng.integers(0, 9, (4, 2)), rng.integers(0, 9, (4, 2)), np.zeros((4, 2), np.float32)
    real = np.ones((4, 2), np.float32)
    real[3, 1] = 0
    changed = targets.copy()
    changed[3, 1] = (changed[3, 1] + 1) % 9
    one, two = (lm_score.window_gradients(params, inputs, x, fresh, np.zeros((2, 3), np.float32), real) for x in (targets, changed))
    assert np.isclose(one[0], two[0]) and all(np.allclose(one[1][k], two[1][k], atol=1e-6) for k in params)


def _identifier(rows, langs):
    models = {}
    for lang in langs:
        columns, _ = language_id._windows(*language_id.letters([r["text"] for r in rows if r["lang"] == lang]))
        grams, counts = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        models[lang] = language_id.KneserNey(grams, counts.astype(float), 40)
    return language_id.Identifier(models)


def test_shuffled_and_unlearned_texts_are_rejected(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").where("lang is not null and length(text) > 200").orderBy("doc_id").collect()
    learned, held = rows[::2], rows[1::2]
    rng = np.random.default_rng(3)
    mixed = lambda t: "".join(rng.permutation(list(t)))
    found = _identifier(learned, ["en", "fr"])
    own = [r for r in held if r["lang"] in ("en", "fr")]
    # One junk text among the held-back ones must not lift the limit.
    found.calibrate([r["text"] for r in own] + ["zq xj kvw qqz " * 40], [r["lang"] for r in own] + ["en"])
    assert found.predict([mixed(r["text"]) for r in own])["rejected"].mean() > 0.97
    assert found.predict([r["text"] for r in rows if r["lang"] in ("de", "es")])["rejected"].mean() > 0.9
    assert found.predict([r["text"] for r in own])["rejected"].mean() < 0.03


def brute_kneser_ney(texts, order=4):
    """Probability of a letter after others, by dictionaries over whole texts."""
    counts = Counter()
    for t in texts:
        t = " " * order + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
        for i in range(order + 1, len(t) + 1) if t.strip() else ():
            counts[t[max(0, i - order) : i]] += 1
    levels = {order: counts}
    for n in range(order - 1, 0, -1):
        levels[n] = Counter(g[1:] for g in levels[n + 1])
    alphabet = len({g[-1] for g in counts})

    def p(before, c):
        out = 1 / (alphabet + 1)
        for n in range(1, order + 1):
            table = levels[n]
            ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
            d = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
            context = before[len(before) - n + 1 :] if n > 1 else ""
            own = {g: v for g, v in table.items() if g[:-1] == context}
            if own:
                out = max(own.get(context + c, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * out
        return out

    return p


def test_models_equal_dictionaries():
    texts = ["the cat, the HAT and the rat", "she sells sea shells", "a b c"]
    columns, _ = language_id._windows(*language_id.letters(texts))
    grams, counts = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
    model = language_id.KneserNey(grams, counts.astype(float), len(np.unique(grams[:, -1])))
    plain = brute_kneser_ney([*texts])
    for before, c in ((" th", "e"), ("the", " "), ("she", "l"), ("zzz", "q"), (" sh", "e"), ("xth", "a"), ("   ", "t")):
        arrays = [np.array([ord(x)], np.uint32) for x in before + c]
        assert abs(model.probability(arrays)[0] - plain(before, c)) < 1e-9, (before, c)


def test_rejection_carries_clashing_names(spark):
    names = ["__p", "p", "doc", "lang_pred", "a.b"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("*", *[mixing.F.lit(c).alias(c) for c in names])
    kept = language_id.keep_identified(spark, docs)
    assert kept.columns == docs.columns and all(list(r)[-len(names) :] == names for r in kept.limit(50).collect())


def test_every_language_is_learned(spark):
    rows = [(i, f"word{chr(97 + i % 26)} text", f"l{i:03d}") for i in range(203)]
    assert len(language_id.train(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).langs) == 203
