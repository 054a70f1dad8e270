"""Secret scan: patterns against a plain scan, the field against all tag paths."""

import hashlib
import itertools
import random
import re

import numpy as np

from hireloom.llm import secrets as S


def plain_base(text):
    """The patterns as they are stated, dropping matches that fail."""
    spans = []
    for kind, pattern in enumerate((
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        "AKIA[A-Z0-9]+", "[0-9a-f]+",
    )):
        for m in re.finditer(pattern, text):
            if len(m[2] if kind == 0 else m[0]) >= (12, 18, 16)[kind]:
                spans.append((m.start(), kind, m.end()))
    return sorted(spans)


def test_patterns_equal_a_plain_scan():
    rng = random.Random(1)
    parts = ["token", "SECRET", "api_key", "apikey", "paſſword", "toKen", " ", '"', "'", ":", "=", " = ", "AKIA", "AKIAAB0", "ABCDEF0123456789ZZ", "0123456789abcdef", "deadbeef", "é", "🙂", "x/y+z_1.-=", "\n", "secret: secret: abcdefghijklmnop"]
    for _ in range(3_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert S.base_spans(text) == plain_base(text)


def test_decoding_finds_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    for spread in (0.5, 3.0):
        moves = rng.normal(size=(4, 3))
        for n in range(1, 7):
            scores = rng.normal(size=(n, 3)) * spread
            scores[:, 0] += rng.choice([0, 12], n)
            value = lambda p: moves[3][p[0]] + sum(scores[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max(itertools.product(range(3), repeat=n), key=value)
            assert tuple(S.viterbi(scores, moves)) == best
            assert tuple(S.decode(scores, moves)) == best


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(size=(2, 4, 3)), rng.normal(size=(4, 3))
    tags, size = rng.integers(0, 3, (2, 4)), np.array([4, 2])
    total, d_scores, d_moves = S.chain_gradient(scores, moves, tags, size)
    brute = 0.0
    for r in range(2):
        value = lambda p: moves[3][p[0]] + sum(scores[r, i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        ways = [value(p) for p in itertools.product(range(3), repeat=int(size[r]))]
        brute += value(tags[r, : size[r]]) - np.log(np.exp(ways).sum())
    assert np.isclose(total, brute)
    for target, grad in ((scores, d_scores), (moves, d_moves)):
        for at in itertools.product(*map(range, target.shape)):
            target[at] += 1e-5
            up = S.chain_gradient(scores, moves, tags, size)[0]
            target[at] -= 1e-5
            assert abs((up - total) / 1e-5 - grad[at]) < 1e-3


def secret(rng):
    return "".join(rng.choice("0123456789abcdef") for _ in range(40))


def test_field_finds_what_patterns_miss_and_leaves_prose_alone():
    rng = random.Random(4)
    words = ["the", "Where", "over", "stone,", "river", "4411", "go.", "mountain", "A", "(see)", "2024-01-02"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    train = [f'{prose(30)} token = "{secret(rng)}" {prose(30)}' for _ in range(150)] + [prose(60) for _ in range(150)]
    weights, moves = S.train([c for t in train for c in S.windows(t)])
    scored = S.Words(weights)
    hit = 0
    for _ in range(40):
        odd = secret(rng)[:34].upper()  # no pattern takes capital digits
        text = f'{prose(30)} token = ("{odd}") {prose(30)}'
        assert not S.base_spans(text)
        hit += any(text[a:b] == odd for a, b in S.tagged_spans(text, moves, scored))
    assert hit >= 30
    assert not any(S.tagged_spans(prose(200), moves, scored) for _ in range(20))


def test_rows_and_edge_cases(spark, docs, corpus, empty):
    got = S.find_secrets(spark, docs, sample=20).collect()
    assert len(got) == len(corpus)
    blank = hashlib.sha256(b"").hexdigest()
    want = sorted(((r[0], hashlib.sha256(S.joined(plain_base(r[1] or "")).encode()).hexdigest()) for r in corpus), key=repr)
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=repr) == want
    assert all(r.spans == "" and r.base_sha256 == blank for r in got if r.doc_id in (85, 86))
    assert S.find_secrets(spark, empty).count() == 0
