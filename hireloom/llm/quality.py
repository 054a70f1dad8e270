"""Quality scores by co-training a text view and a page-metadata view.

The text view sees hashed words and the make-up of words (case, digits, marks,
repeats); the metadata view sees source, language, length and the layout of lines.
Each view is a logistic regression. Over some rounds each scores all unlabelled
training documents and labels those that it is surest of, and the other learns from them. Both are then
calibrated on labelled documents that neither has seen, and their calibrated
log-odds are combined.

The classifiers are fitted on a bounded sample of the labelled documents, chosen
by hash: `LABELLED`, whole texts. Every unlabelled document outside the held-out
fold is a candidate in every round, and all documents are scored. Texts stay in
the tasks; the driver gets the features of labelled and chosen documents only.
"""

from __future__ import annotations

import copy
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, tidy
from .language_id import held_out
from .ngram_join import SLICE, word_hashes

LABELLED = 4_000
WORD_CELLS, SHAPE_CELLS = 1 << 14, 1 << 9
#: Numbers of the text view: shares of capitals, digits and marks, of distinct words, and the length of words.
SHARES = 5
SOURCES, LANGS = 64, 16
#: Numbers of the metadata view: characters, lines, characters a line.
NUMBERS = 3
ROUNDS, PER_ROUND = 4, 200
#: The threshold lies below this quantile of good documents that the classifiers haven't seen, by a margin,
#: and above this quantile of the bad ones where the two are apart. Some wrong labels move neither.
GOOD_AT, BAD_AT = 0.02, 0.75

_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[48:58] = 4
_KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 8
_KIND[128:] = 16


TEXT_CELLS = WORD_CELLS + SHAPE_CELLS + SHARES


class Rows:
    """A sparse matrix by rows."""

    def __init__(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray, width: int):
        self.index, self.value, self.starts, self.width = index, value, starts, width

    def __len__(self):
        return len(self.starts) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0.0], np.cumsum(w[self.index] * self.value, dtype=np.float64)))
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def dot_t(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=np.repeat(r, np.diff(self.starts)) * self.value, minlength=self.width)

    @classmethod
    def of(cls, parts: list[tuple[np.ndarray, np.ndarray]], width: int | None = None) -> "Rows":
        """From (index, value) of each row."""
        starts = np.concatenate(([0], np.cumsum([len(i) for i, _ in parts]))).astype(np.int64)
        cat = lambda k, t: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, t)
        return cls(cat(0, np.int64), cat(1, np.float64), starts, width or TEXT_CELLS)


def features(texts: list[str | None], sources: list, langs: list, n_chars: list) -> tuple[Rows, np.ndarray]:
    """Text view (sparse) and metadata view (dense) of whole documents."""
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    parts, meta = [], []
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) < SLICE:
            size += len(raw[hi])
            hi += 1
        p, m = _slice_features(raw[lo:hi])
        parts += p
        meta.append(m)
        lo = hi
    text = Rows.of(parts)
    dense = np.zeros((len(raw), NUMBERS + SOURCES + LANGS + 1))
    if raw:
        dense[:, :NUMBERS] = np.concatenate(meta)
    for i, (s, x, n) in enumerate(zip(sources, langs, n_chars)):
        dense[i, 0] = np.log1p(len(texts[i] or "") if n is None else max(0, n)) / 8
        dense[i, NUMBERS + zlib.crc32(repr(s).encode("utf-8", "replace")) % SOURCES] = 1
        dense[i, NUMBERS + SOURCES + zlib.crc32(repr(x).encode("utf-8", "replace")) % LANGS] = 1
    dense[:, -1] = 1
    return text, dense


def _slice_features(raw: list[bytes]):
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    words, begin, end = word_hashes(np.frombuffer(data.tobytes().lower(), dtype=np.uint8))
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    first = np.searchsorted(begin, offsets)
    kind = _KIND[data]
    if len(words):
        made = np.bitwise_or.reduceat(kind, begin)
        run = 2 * (kind[end - 1] == 8) + ((kind[end - 1] == 8) & (end - begin > 1) & (kind[np.maximum(end - 2, 0)] == 8))
        again = np.concatenate(([False], words[1:] == words[:-1]))
        shape = (made.astype(np.int64) & 31) | run.astype(np.int64) << 5 | again.astype(np.int64) << 7
        cell = (words % np.uint64(WORD_CELLS)).astype(np.int64)
    parts, meta = [], np.zeros((len(raw), NUMBERS))
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        own = kind[offsets[i] : offsets[i + 1] - 1]
        n = max(1, len(own))
        lines = raw[i].count(b"\n") + 1
        meta[i, 1:] = [np.log1p(lines) / 4, np.log1p(n / lines) / 8]
        shares = [
            (own == 1).sum() / n * 4, (own == 4).sum() / n * 8, (own == 8).sum() / n * 8,
            len(np.unique(words[a:b])) / max(1, b - a) if b > a else 0, n / max(1, b - a) / 16,
        ]
        if b > a:
            w, c = np.unique(cell[a:b], return_counts=True)
            v = np.log1p(c)
            s, k = np.unique(shape[a:b], return_counts=True)
            made_of = np.arange(TEXT_CELLS - SHARES, TEXT_CELLS)
            parts.append((np.concatenate([w, WORD_CELLS + s, made_of]), np.concatenate([v / np.sqrt((v * v).sum()), 3 * np.sqrt(k / (b - a)), shares])))
        else:
            parts.append((np.empty(0, np.int64), np.empty(0)))
    return parts, meta


def logistic(dot, dot_t, y: np.ndarray, width: int, steps: int = 150, decay: float = 1e-4, prior: list[float] | None = None) -> np.ndarray:
    """Weights and bias (last) by Adam on the whole batch, drawn towards `prior` (zero)."""
    prior = np.zeros(width + 1) if prior is None else np.array(prior)
    w, m, v = prior.copy(), np.zeros(width + 1), np.zeros(width + 1)
    for i in range(steps):
        p = 1 / (1 + np.exp(-np.clip(dot(w[:-1]) + w[-1], -30, 30)))
        r = (p - y) / len(y)
        g = np.append(dot_t(r), r.sum()) + decay * (w - prior)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.1 * (m / (1 - 0.9 ** (i + 1))) / (np.sqrt(v / (1 - 0.99 ** (i + 1))) + 1e-8)
    return w


class CoTrained:
    """Two view classifiers, their calibration and the threshold."""

    def __init__(self):
        self.text = self.meta = None
        self.scale = np.array([[1.0, 0.0], [1.0, 0.0]])
        self.blend = np.array([0.5, 0.5, 0.0])
        self.threshold = 0.0

    @staticmethod
    def _fit(view, y):
        if isinstance(view, Rows):
            return logistic(view.dot, view.dot_t, y, view.width)
        return logistic(lambda w: view @ w, lambda r: view.T @ r, y, view.shape[1])

    @staticmethod
    def _logit(view, w):
        return np.clip((view.dot(w[:-1]) if isinstance(view, Rows) else view @ w[:-1]) + w[-1], -30, 30)

    def fit_views(self, known: list[list["Known"]]) -> None:
        """Each view learns from its own list of known documents."""
        self.text = self._fit(Rows.of([d.text for d in known[0]]), np.array([d.label for d in known[0]], float))
        self.meta = self._fit(np.stack([d.meta for d in known[1]]), np.array([d.label for d in known[1]], float))

    def logits(self, text: Rows, meta: np.ndarray) -> np.ndarray:
        return np.stack([self._logit(text, self.text), self._logit(meta, self.meta)], 1)

    def calibrate(self, held: list["Known"]) -> None:
        """Scales, blend and threshold from labelled documents that the views haven't seen."""
        good = np.array([d.label == 1 for d in held], bool)
        if not len(held) or not 0 < good.mean() < 1:
            return
        # Smoothed targets and a pull to plain, equally weighted views: few documents change little.
        target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
        pull = 0.1 / (1.0 + min(good.sum(), (~good).sum()))
        both = self.logits(Rows.of([d.text for d in held]), np.stack([d.meta for d in held]))
        for k in range(2):
            one = both[:, [k]]
            self.scale[k] = logistic(lambda w: one @ w, lambda r: one.T @ r, target, 1, steps=300, decay=pull, prior=[1.0, 0.0])
            self.scale[k, 0] = max(self.scale[k, 0], 0.05)
        scaled = both * self.scale[:, 0] + self.scale[:, 1]
        self.blend = logistic(lambda w: scaled @ w, lambda r: scaled.T @ r, target, 2, steps=300, decay=pull, prior=[0.5, 0.5, 0.0])
        self.blend[:2] = np.maximum(self.blend[:2], 0.05)
        logits = scaled @ self.blend[:2] + self.blend[2]
        low, bad = np.quantile(logits[good], GOOD_AT), np.quantile(logits[~good], BAD_AT)
        # A margin below the good documents, but above most of the bad ones.
        self.threshold = float(1 / (1 + np.exp(-np.clip(min(0.0, max(low - 1.0, bad + 0.1 * (low - bad))), -30, 30))))

    def predict(self, text: Rows, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None:
            return tuple(np.full(len(text), 0.5) for _ in range(3))
        both = self.logits(text, meta) * self.scale[:, 0] + self.scale[:, 1]
        squash = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
        return squash(both[:, 0]), squash(both[:, 1]), squash(both @ self.blend[:2] + self.blend[2])


def _score(model):
    def run(batches):
        for batch in batches:
            text, meta = features(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))
            a, b, c = model.value.predict(text, meta)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(a), pa.array(b), pa.array(c), pa.array(c >= model.value.threshold)],
                names=["doc_id", "held_out", "text_score", "meta_score", "score", "keep"],
            )

    return run


class Known:
    """A document that a view learns from or is calibrated on: its features and its label."""

    def __init__(self, row):
        self.doc_id, self.label = row["doc_id"], row["label"]
        self.text, self.meta = (np.array(row["cells"], np.int64), np.array(row["weights"], float)), np.array(row["meta"], float)

    def labelled(self, label: int) -> "Known":
        other = copy.copy(self)
        other.label = label
        return other


def _features(batches):
    for batch in batches:
        text, meta = features(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)))
        spans = list(zip(text.starts[:-1].tolist(), text.starts[1:].tolist()))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([text.index[a:b] for a, b in spans], pa.list_(pa.int64())),
                pa.array([text.value[a:b] for a, b in spans], pa.list_(pa.float64())), pa.array(list(meta), pa.list_(pa.float64())),
            ],
            names=["doc_id", "label", "cells", "weights", "meta"],
        )


def known_documents(docs: DataFrame, chosen: DataFrame) -> list[Known]:
    """The documents of a short list (doc_id, label); of several rows with one id the first by hash of its text."""
    rows = docs.join(F.broadcast(chosen), "doc_id")  # at most a few thousand ids
    one = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min(F.struct(F.xxhash64("text").alias("at"), "text", "source", "lang", "n_chars")).alias("d"))
    ready = one.select("doc_id", "label", "d.text", "d.source", "d.lang", "d.n_chars")
    found = ready.mapInArrow(tidy(_features), "doc_id long, label int, cells array<long>, weights array<double>, meta array<double>")
    return sorted(map(Known, found.collect()), key=lambda d: d.doc_id)


def _logits(model):
    def run(batches):
        for batch in batches:
            both = model.value.logits(*features(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "text_logit", "meta_logit"])

    return run


def surest(pool: DataFrame, good: float) -> DataFrame:
    """(teacher, label, doc_id): what each view is surest of, in the proportion of the classes."""
    parts = []
    for teacher, column in ((0, "text_logit"), (1, "meta_logit")):
        for label, order, most in ((1, F.desc(column), max(1, int(PER_ROUND * good))), (0, F.asc(column), max(1, int(PER_ROUND * (1 - good))))):
            sure = pool.where(F.col(column) > 0 if label else F.col(column) < 0).orderBy(order, "doc_id").limit(most)
            parts.append(sure.select(F.lit(teacher).alias("teacher"), F.lit(label).alias("label"), "doc_id"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> CoTrained:
    """Fit on documents outside the held-out fold; a document with several labels has the lowest."""
    scratch = Scratch(spark, "quality")
    known = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
    known = scratch.keep(known, "labels")
    rows = docs.where("not held_out").select("doc_id", "text", "source", "lang", "n_chars")
    usable = scratch.keep(rows.select("doc_id").join(known, "doc_id").distinct(), "labelled")
    share = labelled / max(1, usable.count())
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("quality")), 11) / F.lit(float(1 << 53))
    sample = known_documents(rows, usable.where(place < share))  # `labelled` rows, give or take their square root
    model = CoTrained()
    held = [d for d in sample if zlib.crc32(f"calibrate {d.doc_id}".encode()) % 4 == 0]
    learn = [d for d in sample if zlib.crc32(f"calibrate {d.doc_id}".encode()) % 4 != 0]
    good = float(np.mean([d.label for d in learn])) if learn else 0.0
    if not 0 < good < 1:
        return model
    views = [list(learn), list(learn)]
    used: set[int] = set()
    for _ in range(ROUNDS):
        model.fit_views(views)
        shared = spark.sparkContext.broadcast(model)
        scores = scratch.keep(rows.where("doc_id is not null").mapInArrow(tidy(_logits(shared)), "doc_id long, text_logit double, meta_logit double"), "logits")
        shared.destroy()
        taken = spark.createDataFrame([(i,) for i in sorted(used)], "doc_id long")  # at most ROUNDS x 2 x PER_ROUND ids
        pool = scores.join(known, "doc_id", "left_anti").join(F.broadcast(taken), "doc_id", "left_anti")
        picks = surest(pool, good).collect()
        if not picks:
            break
        fresh = spark.createDataFrame([(i, 0) for i in sorted({r["doc_id"] for r in picks})], "doc_id long, label int")
        by_id = {d.doc_id: d for d in known_documents(rows, fresh)}
        for teacher in (0, 1):
            for doc_id, label in sorted({r["doc_id"]: r["label"] for r in picks if r["teacher"] == teacher}.items()):
                views[1 - teacher].append(by_id[doc_id].labelled(label))
        used |= set(by_id)
        scratch.drop(scores)
    model.fit_views(views)
    model.calibrate(held)
    return model


def score_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, text_score, meta_score, score, keep.

    Scores are calibrated probabilities of quality 1. Labels of the held-out
    fold are never used. `keep` is score >= a threshold that nearly all good
    documents pass. Null text counts as empty, null source and lang are values
    of their own, a null n_chars is counted from the text. Without labels of
    both kinds all scores are 0.5 and all rows are kept. Rows that repeat get
    equal scores, as do null ids with equal text; a document with several labels
    has the lowest, and of documents equally sure the smallest id is chosen. Whole texts count,
    however long. An empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["source"].cast("string").alias("source"),
        docs["lang"].cast("string").alias("lang"), docs["n_chars"].cast("long").alias("n_chars"),
    ).withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    model = spark.sparkContext.broadcast(train(spark, rows, labels))  # a few times WORD_CELLS numbers
    return rows.select("doc_id", "held_out", "text", "source", "lang", "n_chars").mapInArrow(
        tidy(_score(model)), "doc_id long, held_out boolean, text_score double, meta_score double, score double, keep boolean"
    )
