"""Language identification with interpolated Kneser-Ney character models.

A text is reduced to lower-case letters with one space between words. Per
language, a model of order `ORDER` gives each letter a probability from the
three before it: absolute discounting at the top, continuation counts below,
uniform at the bottom. All n-grams of all languages are kept as sorted arrays
of 64-bit hashes with their counts. The language with the lowest cross-entropy
per letter wins.

The classifier is fitted on a bounded sample: `DOCS_PER_LANG` documents of each
language, chosen by hash, whole texts. A quarter of the
sample is held back to fit the temperature of the scores and, per language, the
cross-entropy above which a text is rejected. Everything else reads all rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import give_back, tidy

ORDER = 4
DOCS_PER_LANG = 800
MEMO_BITS = 18
#: Numbers (n-grams x languages) that a table of n-grams or a step of scoring holds at most, for many languages.
CELLS = 1 << 24
#: Characters, and texts, that are scored at once: every core's worker holds their numbers.
SLICE, TEXTS = 1 << 17, 256
#: A text is rejected when its cross-entropy exceeds the `OWN` quantile of those held back by this
#: share of the way to the `NOISE` quantile of the same texts with their letters shuffled.
REJECT_AT = 0.25
OWN, NOISE = 0.98, 0.05
#: With fewer texts held back than this only what scores like shuffled letters is rejected.
FEW_HELD = 5
#: Languages with fewer documents than this hold none back.
FEW_DOCS = 20
UNDETERMINED = "und"

_KEYS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
_SPACE = 32
_CHARS: list[np.ndarray] = []


def _char_table() -> np.ndarray:
    """Code point -> its lower-case letter, or a space if it is no letter."""
    if not _CHARS:
        table = np.full(0x110000, _SPACE, dtype=np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _CHARS.append(table)
    return _CHARS[0]


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Reduced code points of all texts in a row, each led by a space, and where each text starts (and the end)."""
    joined = "\n".join(" " if t is None else " " + t for t in texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), dtype=np.uint32)
    # A text's own length in code points, with its leading space; the line feed after it is dropped below.
    sizes = np.array([1 if t is None else len(t) + 1 for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    reduced = _char_table()[points]
    is_space = reduced == _SPACE
    keep = np.ones(len(reduced), dtype=bool)
    keep[1:] = ~(is_space[1:] & is_space[:-1])
    keep[starts + sizes] = False  # the separating line feeds
    keep[starts] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return reduced[keep], np.append(kept[starts], kept[-1])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams given as one array per position, first letter first."""
    h = np.full(len(columns[0]), len(columns), dtype=np.uint64)
    for k, c in enumerate(columns):
        h += (c.astype(np.uint64) + np.uint64(1)) * _KEYS[k]
    return mix(h)


def _sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, inverse = np.unique(keys, return_inverse=True)
    return found, np.bincount(inverse, weights=values, minlength=len(found))


@dataclass
class SortedCounts:
    """Sorted hash array with two numbers per entry; what isn't there counts as 0."""

    keys: np.ndarray
    counts: np.ndarray

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


class KneserNey:
    """Interpolated Kneser-Ney model of one language, from its `ORDER`-gram counts."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        self.alphabet = alphabet
        self.tables, self.totals, self.kinds, self.discounts = {}, {}, {}, {}
        for n in range(ORDER, 0, -1):
            columns = [grams[:, k] for k in range(n)]
            keys, total = _sum_by(gram_hash(columns), counts)
            self.tables[n] = SortedCounts(keys, total)
            ones, twos = float((total == 1).sum()), float((total == 2).sum())
            self.discounts[n] = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
            if n > 1:
                context = gram_hash([grams[:, k] for k in range(n - 1)])
            else:
                context = np.zeros(len(grams), dtype=np.uint64)
            self.totals[n] = SortedCounts(*_sum_by(context, counts))
            self.kinds[n] = SortedCounts(*_sum_by(context, np.ones(len(counts))))
            # Below, an n-gram counts the different letters that were seen before it.
            grams, index = np.unique(grams[:, 1:], axis=0, return_inverse=True)
            counts = np.bincount(index.reshape(-1), minlength=len(grams)).astype(float)

    def probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """P(last letter | those before) for arrays of `ORDER` letters."""
        p = np.full(len(columns[0]), 1.0 / (self.alphabet + 1))
        for n in range(1, ORDER + 1):
            part = columns[ORDER - n :]
            context = gram_hash(part[:-1]) if n > 1 else np.zeros(len(p), dtype=np.uint64)
            total, d = self.totals[n].get(context), self.discounts[n]
            seen = np.maximum(self.tables[n].get(gram_hash(part)) - d, 0.0) + d * self.kinds[n].get(context) * p
            p = np.where(total > 0, seen / np.maximum(total, 1.0), p)
        return p


def _windows(points: np.ndarray, starts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The `ORDER` letters ending at each position but a text's leading space, and the text of each."""
    size = np.diff(starts)
    doc = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(points)) - starts[doc]
    here = np.flatnonzero(place > 0)
    columns = []
    for back in range(ORDER - 1, -1, -1):
        inside = place[here] >= back  # before its start a text has spaces
        columns.append(np.where(inside, points[np.maximum(here - back, 0)], _SPACE).astype(np.uint32))
    return columns, doc[here]


class Identifier:
    """Models of all learned languages, and the calibration of their scores."""

    def __init__(self, models: dict[str, KneserNey], temperature: float = 0.1, limits: dict[str, float] | None = None):
        self.langs = sorted(models)
        self.models = models
        self.temperature = temperature
        self.limits = limits or {}
        self._memo: tuple[np.ndarray, np.ndarray] | None = None

    def __getstate__(self):
        return self.__dict__ | {"_memo": None}

    def _bits(self, columns: list[np.ndarray]) -> np.ndarray:
        """-log2 probability by language (columns) of n-grams; those met before come from a table of fixed size."""
        if self._memo is None:
            size = 1 << min(MEMO_BITS, max(1, (CELLS // len(self.langs)).bit_length() - 1))
            self._memo = np.zeros(size, np.uint64), np.zeros((size, len(self.langs)), np.float32)
        keys, values = self._memo
        hashes = gram_hash(columns)
        slot = (hashes >> np.uint64(65 - len(keys).bit_length())).astype(np.int64)
        out = values[slot]
        miss = np.flatnonzero(keys[slot] != hashes)
        if len(miss):
            new, first, inverse = np.unique(hashes[miss], return_index=True, return_inverse=True)
            own = [c[miss][first] for c in columns]
            bits = np.stack([-np.log2(self.models[x].probability(own)) for x in self.langs], axis=1).astype(np.float32)
            out[miss] = bits[inverse]
            at = slot[miss][first]
            values[at], keys[at] = bits, new
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages) bits per position, and whether a text has a letter."""
        totals, letter = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), bool)
        lo = 0
        while lo < len(texts):  # slices of about `SLICE` characters, or one longer text
            hi, size = lo + 1, len(texts[lo] or "")
            while hi < len(texts) and size + len(texts[hi] or "") < SLICE:
                size += len(texts[hi] or "")
                hi += 1
            totals[lo:hi], letter[lo:hi] = self._slice(texts[lo:hi])
            lo = hi
        return totals, letter

    def _slice(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        points, starts = letters(texts)
        has = np.add.reduceat(points != _SPACE, starts[:-1], dtype=np.int64) > 0
        columns, doc = _windows(points, starts)
        total = np.zeros((len(texts), len(self.langs)))
        step = max(1, min(SLICE, CELLS // max(1, len(self.langs))))
        for at in range(0, len(doc), step):
            part = slice(at, at + step)
            bits = self._bits([c[part] for c in columns])
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(doc[part], weights=bits[:, k], minlength=len(texts))
        return total / np.maximum(np.bincount(doc, minlength=len(texts)), 1)[:, None], has

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        if not self.langs:
            return pd.DataFrame({"lang_pred": [UNDETERMINED] * len(texts), "score": 0.0, "bits": None, "rejected": True}).astype({"bits": float})
        bits, has = self.cross_entropies(texts)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(texts)), best]
        score = 1.0 / np.exp((low[:, None] - bits) / self.temperature).sum(axis=1)
        names = np.array(self.langs, dtype=object)[best]
        limit = np.array([self.limits.get(x, np.inf) for x in self.langs])[best]
        return pd.DataFrame(
            {
                "lang_pred": np.where(has, names, UNDETERMINED),
                "score": np.where(has, np.clip(score, 0.0, 1.0), 0.0),
                "bits": np.where(has, low, np.nan),
                "rejected": ~has | (low > limit),
            }
        )

    def measure(self, texts: list[str], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of labelled texts with letters: the language's number, the bits by language, and the least bits with the letters shuffled."""
        texts, langs = zip(*[(t, x) for t, x in zip(texts, langs) if x in self.models]) if texts else ((), ())
        if not texts:
            return np.empty(0, int), np.empty((0, len(self.langs))), np.empty(0)
        bits, has = self.cross_entropies(list(texts))
        truth = np.array([self.langs.index(x) for x in langs], dtype=int)
        shuffled = lambda t: "".join(np.random.default_rng(zlib.crc32(t.encode("utf-8", "replace"))).permutation(list(t)))
        noise, _ = self.cross_entropies([shuffled(t) for t, h in zip(texts, has) if h])
        return truth[has], bits[has], noise.min(axis=1)

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Temperature by likelihood, and limits, from labelled texts that the models haven't seen."""
        self.fit_limits(*self.measure(texts, langs))

    def fit_limits(self, truth: np.ndarray, bits: np.ndarray, noise: np.ndarray) -> None:
        """`calibrate` from what `measure` found."""
        if not len(truth):
            return
        own = bits[np.arange(len(truth)), truth]
        grid = [0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0]
        loss = [np.log(np.exp(-(bits - own[:, None]) / t).sum(axis=1)).mean() for t in grid]
        self.temperature = grid[int(np.argmin(loss))]
        for k, lang in enumerate(self.langs):
            mine = truth == k
            far = float(np.quantile(noise[mine] if mine.any() else noise, NOISE))
            near = float(np.quantile(own[mine], OWN)) if mine.sum() >= FEW_HELD else far
            # Where real texts score no better than shuffled ones, the two can't be told apart and real ones stay.
            self.limits[lang] = near + REJECT_AT * max(0.0, far - near)


def _count_grams(batches):
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in sorted(set(langs.tolist())):
            points, starts = letters([t for t, x in zip(texts, langs) if x == lang])
            columns, _ = _windows(points, starts)
            if not len(columns[0]):
                continue
            _, first, counts = np.unique(gram_hash(columns), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(first))] + [pa.array(c[first].astype(np.int32)) for c in columns] + [pa.array(counts)],
                names=["lang", *[f"c{k}" for k in range(ORDER)], "n"],
            )


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32 of the id as text mod `folds` is `fold`; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def train(spark: SparkSession, labelled: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> Identifier:
    """Fit an identifier on (doc_id, text, lang); rows with null text or lang are left out."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = rows.groupBy("lang").count().orderBy("lang").collect()
    if not sizes:
        return Identifier({})
    share = spark.createDataFrame(
        [(r["lang"], min(1.0, docs_per_lang / r["count"]), r["count"] < FEW_DOCS) for r in sizes], "lang string, share double, few boolean"
    )
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) / F.lit(float(1 << 53))
    sample = rows.join(F.broadcast(share), "lang").where(place < F.col("share"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    grams = (
        sample.where(~part | F.col("few"))
        .select("text", "lang")
        .mapInArrow(tidy(_count_grams), "lang string, " + ", ".join(f"c{k} int" for k in range(ORDER)) + ", n long")
        .groupBy("lang", *[f"c{k}" for k in range(ORDER)])
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    if not len(grams):
        return Identifier({})
    alphabet = int(grams[f"c{ORDER - 1}"].nunique())
    models = {}
    for lang, own in grams.sort_values(["lang", *[f"c{k}" for k in range(ORDER)]]).groupby("lang"):
        models[lang] = KneserNey(own[[f"c{k}" for k in range(ORDER)]].to_numpy(np.uint32), own["n"].to_numpy(float), alphabet)
    found = Identifier(models)
    # The texts stay in the tasks; only their numbers come here.
    model = spark.sparkContext.broadcast(found)
    held = sample.where(part).select("doc_id", "text", "lang").mapInArrow(tidy(_measure(model)), "doc_id long, truth int, bits array<double>, noise double")
    held = held.orderBy("doc_id", "noise").toPandas()
    model.destroy()
    if len(held):
        found.fit_limits(held["truth"].to_numpy(int), np.stack(held["bits"].to_list()), held["noise"].to_numpy(float))
    return found


def _measure(model):
    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):  # one by one, so that doc_id stays with its numbers
                truth, bits, noise = model.value.measure(batch.column(1).slice(at, 1).to_pylist(), batch.column(2).slice(at, 1).to_pylist())
                if len(truth):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(at, 1), pa.array(truth, pa.int32()), pa.array(bits.tolist(), pa.list_(pa.float64())), pa.array(noise)],
                        names=["doc_id", "truth", "bits", "noise"],
                    )

    return run


def predictor(spark: SparkSession, identifier: Identifier):
    """An Arrow UDF text -> struct(lang_pred, score, bits, rejected); texts leave their batch a few at a time."""
    model = spark.sparkContext.broadcast(identifier)  # bounded by the sample it was fitted on
    kind = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("bits", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf("lang_pred string, score double, bits double, rejected boolean")
    def predict(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            found = [model.value.predict(batch.slice(at, TEXTS).to_pylist()) for at in range(0, max(1, len(batch)), TEXTS)]
            yield pa.Table.from_pandas(pd.concat(found), kind, preserve_index=False).combine_chunks().to_struct_array().combine_chunks()
        give_back()

    return predict


def identify(spark: SparkSession, docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, lang_pred, score, bits, rejected.

    Learns from rows outside the fold that have text and lang; predictions use
    the text alone. Null texts and texts without a letter are `und`, score 0
    and rejected. If nothing can be learned, all rows are. Of languages equally
    likely the first by name wins. Very long texts are scored in slices and
    count as a whole. Repeats give repeats, an empty table an empty result, and other columns are
    not read.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"], docs["lang"]).withColumn(
        "held_out", held_out(F.col("doc_id"), folds, fold)
    )
    found = train(spark, rows.where("not held_out"))
    out = rows.select("doc_id", "held_out", predictor(spark, found)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.bits", "p.rejected")


def keep_identified(spark: SparkSession, docs: DataFrame, folds: int = 4, fold: int = 2) -> DataFrame:
    """`docs` without the rows that `identify` rejects, all columns as they were.

    Texts that are null, empty or without letters go; so do those that score
    nearer to shuffled letters than to any learned language. Null ids and
    langs are kept like others, and rows that repeat stay or go together. Ties
    of languages change nothing here. Whole texts count, however long. An
    empty table gives an empty result, and columns of any name are carried
    through.
    """
    found = train(spark, docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id"), folds, fold)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(whole, predictor(spark, found)(docs["text"]).alias("p")).where("not p.rejected").select("doc.*")
