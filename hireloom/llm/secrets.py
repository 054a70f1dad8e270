"""Secret scan: patterns, and a linear-chain conditional random field beside them.

Tokens (words) are tagged begin, inside or outside of a secret. A token's
weights come from its shape and characters, from the words and shapes at its
sides and from features of its file; neighbouring tags are tied by a table of
transitions. Training maximises the likelihood of tag chains by gradient
steps with forward and backward sums; decoding is Viterbi's. The chains to
learn from are windows around the patterns' matches and windows without any,
of a bounded sample of documents; a token's own letters are not among its
features, so that what is learnt is the look of a secret and its surroundings.
"""

from __future__ import annotations

import hashlib
import re
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import small_batches, tidy

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: Runs of the minimal length: a shorter run holds no longer one, so none is missed by asking for the length at once.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Names of `ASSIGN` in lower case: a plain search for them spares most texts the pattern.
NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "crf")
LEAST = 12

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What a tagged span loses at its ends.
EDGES = "\"'`.,;:!?()[]{}<>*#$%&"

#: Documents of each kind (with and without a match) that training may read, and windows of one document.
SAMPLE, WINDOWS, AROUND = 600, 4, 8
#: Hashed weights, passes and step of training.
SPACE, EPOCHS, STEP, SHRINK = 1 << 13, 30, 0.3, 1e-4
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
#: What the tags of a span must score above "all outside", beside the best path's own choice.
MARGIN = 2.0

RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the patterns, in order of start and kind."""
    low = len(text) >= LEAST
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST] if low else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)] + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _slot(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % SPACE


class Words:
    """Scores of distinct words in each place (itself, before, after), remembered up to a bound.

    A row holds three scores a place, then the word's digits, marks and characters.
    """

    def __init__(self, weights: np.ndarray, bound: int = 300_000):
        self.weights, self.bound = weights, bound
        self.at: dict[str, int] = {}
        self.by_look: dict[tuple, np.ndarray] = {}
        self.table = np.empty((bound, 12))

    def rows(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), 12))
        for lo in range(0, len(words), self.bound // 2):  # a part has at most half as many words as fit
            part = words[lo : lo + self.bound // 2]
            codes = [self.at.get(w, -1) for w in part]
            if -1 in codes:
                new = {w for w, c in zip(part, codes) if c < 0}
                if len(self.at) + len(new) > self.bound:
                    self.at.clear()
                    new = set(part)
                for w in new:
                    self.table[len(self.at)] = self.scored(w)
                    self.at[w] = len(self.at)
                codes = [self.at[w] for w in part]
            out[lo : lo + len(part)] = self.table[codes]
        return out

    def scored(self, word: str) -> np.ndarray:
        name, look = looks(word)
        row = self.by_look.get(look)
        if row is None:
            if len(self.by_look) >= self.bound:
                self.by_look.clear()
            sums = [self.weights[slots].sum(0) for slots in look_slots(*look)]
            row = self.by_look[look] = np.array([*sums[0], *sums[1], *sums[2], *counted(look[0])])
        if name is None:
            return row
        row = row.copy()
        row[3:6] += self.weights[_slot(f"before {name}")]
        row[6:9] += self.weights[_slot(f"after {name}")]
        return row

    @staticmethod
    def features(word: str) -> tuple[list[int], list[int], list[int]]:
        """Slots of a word as the token itself, as the one before and as the one after."""
        name, look = looks(word)
        own, before, after = look_slots(*look)
        named = [] if name is None else [_slot(f"before {name}")], [] if name is None else [_slot(f"after {name}")]
        return own, before + named[0], after + named[1]


class _Classes(dict):
    """Class of a character for `str.translate`: 0 digit, A upper case, a other letters, - the rest."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = kind = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "-"
        return kind


CLASSES = _Classes()


def looks(word: str) -> tuple[str | None, tuple]:
    """(name of a short word of ASCII letters, its look): classes of all characters, where the core lies, spread, hexadecimal, last mark."""
    classes = word.translate(CLASSES)
    start = len(word) - len(word.lstrip(EDGES))
    core = word.strip(EDGES)
    n = len(core)
    spread = len(set(core)) * 4 // max(min(n, 24), 1) if n > 7 else 4
    look = (classes, start, n, spread, n > 11 and not set(core) - HEXADECIMAL, core.isascii(), word[-1:] if word[-1:] in ":=" else "")
    return core.lower() if n <= 12 and core.isascii() and "0" not in classes else None, look


HEXADECIMAL = set("0123456789abcdef")


def look_slots(classes: str, start: int, n: int, spread: int, hexa: bool, ascii_: bool, ends: str) -> tuple[list[int], list[int], list[int]]:
    core = classes[start : start + n]
    shape = "".join(k for k, _ in groupby(core[:64]))
    turns = min(len(shape), 8)
    size = next(i for i, top in enumerate((0, 3, 7, 11, 15, 19, 31, 47, 1 << 62)) if n <= top)
    mixed = f"{min(core.count('0') * 4 // max(n, 1), 3)}{min(core.count('A') * 4 // max(n, 1), 3)}{ascii_:d}"
    own = [f"size {size}", f"mix {mixed}", f"size {size} mix {mixed}", f"turns {turns}", f"turns {turns} size {size}"]
    own += [f"spread {spread} size {size}", f"marks {min(core.count('-'), 4)}", f"shape {shape[:6]}", f"hex {hexa:d} {size}"]
    folded = "".join(k for k, _ in groupby(core[:64].replace("A", "a")))
    share = min(core.count("0") * 8 // max(n, 1), 5)
    own += [f"digits {share} size {size}", f"folded {min(len(folded), 8)} size {size}", f"folded {min(len(folded), 8)} digits {share}"]
    side = [f"shape {shape[:4]} {size}", f"size {size}", f"ends {ends}"]
    return [_slot(f) for f in own], [_slot(f"before {f}") for f in side], [_slot(f"after {f}") for f in side]


def counted(classes: str) -> tuple[int, int, int]:
    """Digits, marks and characters of a word, from the classes of its characters."""
    return classes.count("0"), classes.count("-"), len(classes)


def file_slots(n_words: int, digits: float, marks: float, chars: float) -> list[int]:
    """Features of a whole file: its length and its shares of digits and of marks."""
    share = lambda n, top: min(int(n * 20 // max(chars, 1)), top)
    return [_slot(f"file length {n_words.bit_length() // 2}"), _slot(f"file digits {share(digits, 4)}"), _slot(f"file marks {share(marks, 6)}")]


def emissions(words: list[str], scores: Words) -> np.ndarray:
    """Scores of every token and tag: the token's own, those of the words at its sides and those of the file."""
    if not words:
        return np.zeros((0, 3))
    rows = scores.rows(words)
    out = rows[:, :3] + scores.weights[file_slots(len(words), *rows[:, 9:].sum(0))].sum(0)
    out[1:] += rows[:-1, 3:6]
    out[:-1] += rows[1:, 6:9]
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags of one chain; `moves` holds the transitions and, as its last row, the start."""
    n = len(scores)
    back = np.zeros((n, 3), np.int8)
    best = scores[0] + moves[3]
    for t in range(1, n):
        ways = best[:, None] + moves[:3]
        back[t] = ways.argmax(0)
        best = ways.max(0) + scores[t]
    tags = np.empty(n, np.int8)
    tags[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        tags[t - 1] = back[t, tags[t]]
    return tags


def decode(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Viterbi tags of a whole document.

    A token that is worse off as a secret by more than all that transitions can
    pay back is outside on the best path, so the chain falls apart there
    into short ones that are decoded with an outside token at either end.
    """
    tags = np.zeros(len(scores), np.int8)
    paid = 2 * (moves.max() - moves.min())
    open_ = np.flatnonzero(scores[:, OUTSIDE] - scores[:, 1:].max(1) <= paid)
    if not len(open_):
        return tags
    for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1):
        lo, hi = max(int(run[0]) - 1, 0), min(int(run[-1]) + 2, len(scores))
        part = scores[lo:hi].copy()
        for at in (lo, hi - 1):
            if at not in (run[0], run[-1]):
                part[at - lo, 1:] = -1e9
        tags[lo:hi] = viterbi(part, moves if lo == 0 else np.vstack([moves[:3], np.zeros((1, 3))]))
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def chain_gradient(scores: np.ndarray, moves: np.ndarray, tags: np.ndarray, size: np.ndarray):
    """Log likelihood of tag chains (rows, padded to one length), and its gradients by scores and by moves."""
    rows, n, _ = scores.shape
    live = np.arange(n)[None, :] < size[:, None]
    ahead = np.zeros_like(scores)
    ahead[:, 0] = scores[:, 0] + moves[3]
    for t in range(1, n):
        step = _log_sum(ahead[:, t - 1, :, None] + moves[None, :3], 1) + scores[:, t]
        ahead[:, t] = np.where(live[:, t, None], step, ahead[:, t - 1])
    total = _log_sum(ahead[:, -1], 1)
    behind = np.zeros_like(scores)
    d_moves = np.zeros((4, 3))
    for t in range(n - 2, -1, -1):
        onward = scores[:, t + 1] + behind[:, t + 1]
        behind[:, t] = np.where(live[:, t + 1, None], _log_sum(moves[None, :3] + onward[:, None, :], 2), 0)
        both = np.exp(ahead[:, t, :, None] + moves[None, :3] + onward[:, None, :] - total[:, None, None])
        d_moves[:3] -= both[live[:, t + 1]].sum(0)
    here = np.exp(ahead + behind - total[:, None, None]) * live[:, :, None]
    d_scores = np.eye(3)[tags] * live[:, :, None] - here
    d_moves[3] = d_scores[:, 0].sum(0)
    pairs = live[:, 1:]
    np.add.at(d_moves, (tags[:, :-1][pairs], tags[:, 1:][pairs]), 1)
    picked = np.take_along_axis(scores, tags[:, :, None], 2)[:, :, 0]
    gold = (picked * live).sum(1) + moves[3][tags[:, 0]] + (moves[tags[:, :-1], tags[:, 1:]] * pairs).sum(1)
    return float((gold - total).sum()), d_scores, d_moves


def _tagged(text: str) -> tuple[list[re.Match], np.ndarray]:
    """Words of a text and their tags by the patterns: the first word that holds a secret begins it."""
    words = list(WORD.finditer(text))
    tags = np.zeros(len(words), np.int64)
    spans = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    spans += [(m.start(), m.end()) for p in (ACCESS, HEX) for m in p.finditer(text)]
    starts = np.array([w.start() for w in words] or [0])
    for lo, hi in sorted(set(spans)):
        at = max(int(np.searchsorted(starts, lo, "right")) - 1, 0)
        if tags[at]:
            continue
        tags[at] = BEGIN
        while at + 1 < len(words) and words[at + 1].start() < hi:
            at += 1
            tags[at] = INSIDE
    return words, tags


def windows(text: str) -> list[tuple[list[list[int]], list[int]]]:
    """Chains to learn from: (slots of each token, tags), around secrets and at even distances without."""
    words, tags = _tagged(text)
    if not words:
        return []
    slots, of_file = Words.features, file_slots(len(words), *np.sum([counted(w.group().translate(CLASSES)) for w in words], axis=0))
    hits = np.flatnonzero(tags == BEGIN)[:WINDOWS]
    plain = np.linspace(0, len(words) - 1, WINDOWS + 2).astype(int)[1:-1]
    out = []
    for mid in sorted({int(m) for m in (*hits, *plain)}):
        lo, hi = max(mid - AROUND, 0), min(mid + AROUND + 1, len(words))
        chain = []
        for i in range(lo, hi):
            own = slots(words[i].group())[0] + of_file
            own = own + (slots(words[i - 1].group())[1] if i else []) + (slots(words[i + 1].group())[2] if i + 1 < len(words) else [])
            chain.append(own)
        out.append((chain, tags[lo:hi].tolist()))
    return out


def train(chains: list, epochs: int = EPOCHS, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, moves) of a field fitted to chains; without chains nothing is ever a secret."""
    weights, moves = np.zeros((SPACE, 3)), np.zeros((4, 3))
    if not chains:
        weights[:, OUTSIDE] = 1.0
        return weights, moves
    seen_w, seen_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(chains))
        for lo in range(0, len(order), 256):
            some = [chains[i] for i in order[lo : lo + 256]]
            size = np.array([len(c[1]) for c in some])
            scores, tags = np.zeros((len(some), size.max(), 3)), np.zeros((len(some), size.max()), np.int64)
            flat, owner = [], []
            for r, (slots, t) in enumerate(some):
                tags[r, : len(t)] = t
                for i, s in enumerate(slots):
                    flat += s
                    owner += [r * size.max() + i] * len(s)
            flat, owner = np.array(flat), np.array(owner)
            np.add.at(scores.reshape(-1, 3), owner, weights[flat])
            _, d_scores, d_moves = chain_gradient(scores, moves, tags, size)
            grad = np.zeros_like(weights)
            np.add.at(grad, flat, d_scores.reshape(-1, 3)[owner])
            grad = grad / len(some) - SHRINK * weights
            d_moves = d_moves / len(some) - SHRINK * moves
            seen_w += grad**2
            seen_m += d_moves**2
            weights += STEP * grad / np.sqrt(seen_w)
            moves += STEP * d_moves / np.sqrt(seen_m)
    return weights, moves


def _sample_hits(docs: DataFrame) -> DataFrame:
    """(hit, text, draw) of texts that aren't empty: whether a pattern matches."""
    text, low = F.col("text"), F.col("low")
    named = reduce(Column.__or__, [F.contains(low, F.lit(name)) for name in NAMED])
    assign = named & text.rlike(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""")
    hit = assign | (F.contains(text, F.lit("AKIA")) & text.rlike("AKIA[A-Z0-9]{14}")) | text.rlike("[0-9a-f]{16}")
    whole = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("draw")).where(F.length("text") > 0)
    return whole.withColumn("low", F.lower("text")).select(hit.alias("hit"), "text", "draw")


def _sample(docs: DataFrame, sample: int) -> list:
    """Chains of a bounded number of documents of each kind, the same ones at every run."""

    def cut(batches):
        for batch in batches:
            out = []
            for hit, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(hit, chain, tags) for chain, tags in windows(text)]
            yield pa.RecordBatch.from_pylist([{"hit": h, "chain": c, "tags": t} for h, c, t in out], schema=_CHAINS)

    marked = _sample_hits(docs)
    some = [marked.where(kind).orderBy("draw", "text").limit(sample) for kind in (F.col("hit"), ~F.col("hit"))]
    found = some[0].unionByName(some[1]).select("hit", "text").mapInArrow(cut, "hit boolean, chain array<array<int>>, tags array<long>").toArrow()
    chains = zip(found.column("chain").to_pylist(), found.column("tags").to_pylist())
    return sorted(chains, key=repr)


_CHAINS = pa.schema([("hit", pa.bool_()), ("chain", pa.list_(pa.list_(pa.int32()))), ("tags", pa.list_(pa.int64()))])


def tagged_spans(text: str, moves: np.ndarray, scored: Words) -> list[tuple[int, int]]:
    """(start, end) of the secrets that the field finds, without the marks at their ends."""
    words = WORD.findall(text)
    scores = emissions(words, scored)
    tags = decode(scores, moves) if len(scores) else np.zeros(0)
    if not tags.any():
        return []
    places = [(m.start(), m.end()) for m in WORD.finditer(text)]
    out, at = [], 0
    while at < len(tags):
        if not tags[at]:
            at += 1
            continue
        last = at
        while last + 1 < len(tags) and tags[last + 1] == INSIDE:
            last += 1
        gain = (scores[at : last + 1].max(1) - scores[at : last + 1, OUTSIDE]).sum()
        raw = text[places[at][0] : places[last][1]]
        lo = places[at][0] + len(raw) - len(raw.lstrip(EDGES))
        hi = places[last][1] - (len(raw) - len(raw.rstrip(EDGES)))
        if gain >= MARGIN and lo < hi:
            out.append((lo, hi))
        at = last + 1
    return out


def _scan(model):
    def run(batches):
        weights, moves = model.value
        scored = Words(weights)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                base = base_spans(text)
                more, reach = [], 0
                spread = iter(base)
                ahead = next(spread, None)
                for lo, hi in tagged_spans(text, moves, scored):
                    while ahead is not None and ahead[0] < lo:  # the farthest end of what begins before the span
                        reach, ahead = max(reach, ahead[2]), next(spread, None)
                    if reach <= lo and (ahead is None or ahead[0] >= hi):
                        more.append((lo, 3, hi))
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                out.append((doc_id, *counts, digest, joined(sorted(base + more))))
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            names = [f.split()[0] for f in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return tidy(run)


def find_secrets(spark: SparkSession, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of documents (doc_id, text), one row for each row.

    Matches of the patterns stay as they are; what the field finds is added as
    kind `crf` where it overlaps none of them. The field is fitted to at most
    `sample` documents with matches and as many without. Null texts count as empty: no
    spans, and the digest of nothing. Very long texts are tagged whole. Repeated
    rows and ids give a row each and equal texts equal spans; a null doc_id
    stays null. An empty table gives no rows; other columns are ignored.
    """
    with small_batches(spark, 200):
        model = spark.sparkContext.broadcast(train(_sample(docs, sample)))  # SPACE weights a tag whatever the data
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_scan(model), RESULT)
