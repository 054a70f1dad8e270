"""Document log-likelihoods by a gated recurrent language model.

Token counts are gathered over the whole training part. The most frequent
words form the model's vocabulary; the rest share one entry and are told apart
by their counts, so every word has a probability and the model stays
normalised. The output is factored into a class and a word within it.

The network is trained in numpy by truncated backpropagation, data-parallel,
on every training document once: the documents are dealt to rounds by hash. In
each round every task starts from the same weights, trains on its documents of
the round and returns its weights, whose mean (weighted by tokens) starts the
next round.

To score, documents are dealt to chunks. Every task knows the counts of the
`HEAD` most frequent words; a chunk looks up those of its other distinct words
in one join, so no task needs the whole list of words and no word is asked for
by every chunk. A chunk runs all its documents side by side, state carried
from window to window over their whole length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, give_back, small_batches, tidy
from .language_id import held_out

VOCAB = 2_047
CLASS_SIZE = 46
HIDDEN = 24
ROUNDS = 3
#: A task trains on blocks of about this many tokens, which bounds its memory.
BLOCK_TOKENS = 1 << 20
#: Streams of a block: at most so many, and so few that a block makes some steps.
STREAMS, WINDOW, STEPS = 384, 16, 16
CHUNK_CHARS = 24 << 20
MEMO_WORDS = 400_000
#: Words whose counts every task knows, and the longest of them in bytes: 10 MB at most.
HEAD, HEAD_BYTES = 100_000, 64
#: Weights of so many tasks are added up in one.
FAN_IN = 32
#: States whose output is worked out at once; their logits fit a core's cache.
OUTPUT_ROWS = 1 << 13
END, RARE = 0, 1


#: Keys beside the words, which have no space: how many texts were counted, and their characters.
DOCS, CHARS = b" docs", b" chars"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def init_params(vocab: int, hidden: int = HIDDEN, class_size: int = CLASS_SIZE, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    classes = -(-vocab // class_size)
    shapes = {
        "E": (vocab, hidden), "W": (hidden, 3 * hidden), "U": (hidden, 3 * hidden), "b": (3 * hidden,),
        "Wc": (hidden, classes), "bc": (classes,), "Ww": (classes, class_size, hidden), "bw": (classes, class_size),
    }
    params = {k: (rng.standard_normal(s) * (0.3 if len(s) > 1 else 0.0)).astype(np.float32) for k, s in shapes.items()}
    params["Ww"] *= 0.3
    params["bw"][:] = 0
    params["bw"].reshape(-1)[vocab:] = -1e9  # places of the last class that no word has
    return params


def start_from_counts(params: dict[str, np.ndarray], counts: np.ndarray) -> None:
    """Output biases at the words' frequencies, so training starts from the unigram model."""
    classes, size = params["bw"].shape
    padded = np.zeros(classes * size)
    padded[: len(counts)] = counts + 0.1
    mass = padded.reshape(classes, size)
    params["bc"][:] = np.log(mass.sum(1))
    params["bw"][:] = np.where(mass > 0, np.log(np.maximum(mass, 1e-9)), -1e9)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def gru_step(params, x3: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step from input projections x3 and state h: (new h, update gate, reset gate, candidate, h's candidate part)."""
    n = h.shape[1]
    h3 = h @ params["U"]
    gates = _sigmoid(x3[:, : 2 * n] + h3[:, : 2 * n])
    z, r = gates[:, :n], gates[:, n:]
    c = np.tanh(x3[:, 2 * n :] + r * h3[:, 2 * n :])
    return z * (h - c) + c, z, r, c, h3[:, 2 * n :]


def _softmax_at(x: np.ndarray, at: np.ndarray, whole: bool = True) -> np.ndarray:
    """Turn x into its softmax by rows, in place; returns the log probability at one column of each row."""
    if not len(x):
        return x[:, 0].copy()
    x -= x.max()  # one number for all rows is cheaper; rows far below it are shifted on their own
    found = x[np.arange(len(x)), at]
    low = np.flatnonzero(x.max(axis=1) < -40) if found.min() < -40 else ()
    if len(low):
        shift = x[low].max(axis=1)
        x[low] -= shift[:, None]
        found[low] -= shift
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    if whole:
        x /= total[:, None]
    return found - np.log(total)


def _by_class(cls: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """Order of the steps by their class, and the slice of each class in it."""
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    cuts = _runs(cls[order]).tolist()
    return order, [(int(cls[order[lo]]), slice(lo, hi)) for lo, hi in zip(cuts[:-1], cuts[1:])]


def output_logs(params, h: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Natural log probability of the target words for states h: class first, then word in class."""
    size = params["bw"].shape[1]
    cls, inside = target // size, target % size
    out = _softmax_at(h @ params["Wc"] + params["bc"], cls, whole=False)
    order, spans = _by_class(cls)
    hc = h[order]
    logits = np.empty((len(h), size), h.dtype)
    for k, at in spans:
        logits[at] = hc[at] @ params["Ww"][k].T + params["bw"][k]
    out[order] += _softmax_at(logits, inside[order], whole=False)
    return out


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts, and the end."""
    return np.append(np.flatnonzero(np.diff(keys, prepend=-1)), len(keys))


def window_gradients(params, inputs: np.ndarray, targets: np.ndarray, fresh: np.ndarray, h: np.ndarray, real: np.ndarray | None = None):
    """Loss, gradients and last state of one window of (steps x streams).

    `fresh` marks a document's first step; steps where `real` is 0 only fill up and count for nothing.
    """
    steps, streams = inputs.shape
    n = h.shape[1]
    table = params["E"] @ params["W"] + params["b"]
    saved, states = [], []
    keep = 1 - fresh
    for t in range(steps):
        h = h * keep[t][:, None]
        new, z, r, c, u = gru_step(params, table[inputs[t]], h)
        saved.append((h, z, r, c, u))
        states.append(new)
        h = new
    hs, tg = np.concatenate(states), targets.reshape(-1)
    rows = np.arange(len(hs))
    size = params["bw"].shape[1]
    cls, inside = tg // size, tg % size
    g = {}
    dc = hs @ params["Wc"] + params["bc"]
    found = _softmax_at(dc, cls)
    # Steps in order of their class, so that a class is one slice.
    order, spans = _by_class(cls)
    hc = hs[order]
    dw = np.empty((len(hs), size), hs.dtype)
    for k, at in spans:
        np.matmul(hc[at], params["Ww"][k].T, out=dw[at])
        dw[at] += params["bw"][k]
    found[order] += _softmax_at(dw, inside[order])
    dc[rows, cls] -= 1
    dw[rows, inside[order]] -= 1
    if real is not None and not real.all():
        weight = real.reshape(-1).astype(hs.dtype)
        found *= weight
        dc *= weight[:, None]
        dw *= weight[order][:, None]
    loss = -found.sum()
    g["Wc"], g["bc"] = hs.T @ dc, dc.sum(0)
    g["Ww"], g["bw"] = np.zeros_like(params["Ww"]), np.zeros_like(params["bw"])
    dhs = dc @ params["Wc"].T
    dhc = np.empty_like(hc)
    for k, at in spans:
        g["Ww"][k] = dw[at].T @ hc[at]
        g["bw"][k] = dw[at].sum(0)
        np.matmul(dw[at], params["Ww"][k], out=dhc[at])
    dhs[order] += dhc
    dhs = dhs.reshape(steps, streams, n)
    d3s = np.empty((steps, streams, 3 * n), hs.dtype)
    dus = np.empty((steps, streams, 3 * n), hs.dtype)
    dh = np.zeros((streams, n), hs.dtype)
    for t in range(steps - 1, -1, -1):
        prev, z, r, c, u = saved[t]
        dh = dh + dhs[t]
        rest = dh * (1 - z)
        d3, du = d3s[t], dus[t]
        d3[:, :n] = (prev - c) * z * rest
        dcand = d3[:, 2 * n :]
        np.multiply(rest, 1 - c * c, out=dcand)
        d3[:, n : 2 * n] = dcand * u * r * (1 - r)
        du[:, : 2 * n] = d3[:, : 2 * n]
        np.multiply(dcand, r, out=du[:, 2 * n :])
        dh = (dh * z + du @ params["U"].T) * keep[t][:, None]
    g["U"] = np.concatenate([x[0] for x in saved]).T @ dus.reshape(-1, 3 * n)
    # Gradients of the input projections, added up by word.
    flat = inputs.reshape(-1)
    order = np.argsort(flat.astype(np.uint16), kind="stable") if len(params["E"]) <= 1 << 16 else np.argsort(flat, kind="stable")
    cuts = _runs(flat[order])
    dtable = np.zeros_like(table)
    dtable[flat[order[cuts[:-1]]]] = np.add.reduceat(d3s.reshape(-1, 3 * n)[order], cuts[:-1], axis=0)
    g["E"], g["W"], g["b"] = dtable @ params["W"].T, params["E"].T @ dtable, dtable.sum(0)
    return loss, {k: g[k] for k in params}, h


class Trainer:
    """Adam over blocks of documents; every token of every document counts once."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        flat = np.concatenate([v.reshape(-1) for v in params.values()])
        self.flat, self.rate, self.steps, self.tokens = flat, rate, 0, 0
        # The weights by name are views of one array, so a step is a few operations.
        self.params, at = {}, 0
        for k, v in params.items():
            self.params[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        self.m, self.v = np.zeros_like(flat), np.zeros_like(flat)

    def feed(self, docs: list[np.ndarray]) -> None:
        """One pass over `docs` (ids with their end), dealt to streams whose last places are filled up."""
        flat = np.concatenate(docs)
        first = np.zeros(len(flat), np.float32)
        first[np.cumsum([0] + [len(d) for d in docs[:-1]])] = 1
        streams = max(1, min(STREAMS, len(flat) // (WINDOW * STEPS)))
        length = -(-len(flat) // streams)
        self.tokens += len(flat)
        fill = (0, streams * length - len(flat))
        real = np.pad(np.ones(len(flat), np.float32), fill)
        flat, first, real = (np.ascontiguousarray(x.reshape(streams, length).T) for x in (np.pad(flat, fill), np.pad(first, fill), real))
        previous = np.vstack([np.zeros((1, streams), flat.dtype), flat[:-1]])
        inputs = np.where(first > 0, END, previous)
        h = np.zeros((streams, self.params["U"].shape[0]), np.float32)
        for at in range(0, length, WINDOW):
            part = slice(at, at + WINDOW)
            _, g, h = window_gradients(self.params, inputs[part], flat[part], first[part], h, real[part])
            self._step(g, max(1.0, float(real[part].sum())))

    def _step(self, g: dict[str, np.ndarray], tokens: float) -> None:
        self.steps += 1
        d = np.concatenate([g[k].reshape(-1) for k in self.params])
        d /= tokens
        self.m += 0.1 * (d - self.m)
        d *= d
        self.v += 0.001 * (d - self.v)
        far = np.sqrt(self.v / (1 - 0.999**self.steps))
        far += 1e-6
        self.flat -= (self.rate / (1 - 0.9**self.steps)) * self.m / far


def train_on(params: dict[str, np.ndarray], docs: list[np.ndarray], rate: float = 0.01) -> tuple[dict[str, np.ndarray], int]:
    """Weights after one pass over `docs` (ids with their end) by Adam; the tokens seen."""
    trainer = Trainer(params, rate)
    trainer.feed(docs)
    return trainer.params, trainer.tokens


def score_documents(params, ids: list[np.ndarray]) -> np.ndarray:
    """Natural log-likelihood of whole documents (ids with their end), all side by side."""
    order = sorted(range(len(ids)), key=lambda i: -len(ids[i]))
    lens = np.array([len(ids[i]) for i in order])
    flat = np.concatenate([ids[i] for i in order])
    starts = np.cumsum(lens) - lens
    table = (params["E"] @ params["W"] + params["b"]).astype(np.float32)
    h = np.zeros((len(ids), params["U"].shape[0]), np.float32)
    total = np.zeros(len(ids))
    previous = np.zeros(len(ids), np.int64)
    at = 0
    active, shorter = len(ids), -lens
    held: list[tuple] = []
    rows = 0

    def settle():
        who, states, targets = (np.concatenate(x) for x in zip(*held))
        total[:] += np.bincount(who, weights=output_logs(params, states, targets), minlength=len(ids))

    while active:
        active = int(np.searchsorted(shorter, -at, side="left"))  # documents longer than `at`
        if not active:
            break
        new, *_ = gru_step(params, table[previous[:active]], h[:active])
        h[:active] = new
        target = flat[starts[:active] + at]
        held.append((np.arange(active), new, target))
        rows += active
        if rows >= OUTPUT_ROWS:
            settle()
            held, rows = [], 0
        previous[:active] = target
        at += 1
    if held:
        settle()
    out = np.empty(len(ids))
    out[order] = total
    return out


def _count_words(batches):
    counts: Counter[bytes] = Counter()
    docs = size = 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])

    for batch in batches:
        for text in batch.column(0):
            text = text.as_py()
            docs += 1
            size += len(text)
            counts.update(words_of(text))
            if len(counts) > MEMO_WORDS:
                yield out()
                counts = Counter()
    counts.update({DOCS: docs, CHARS: size})
    yield out()


def _train_task(params, vocab, rate: float):
    def run(batches):
        trainer, ids_of = Trainer(params.value, rate), vocab.value
        docs, held = [], 0
        for batch in batches:
            for text in batch.column(0):
                own = words_of(text.as_py())
                docs.append(np.append(np.fromiter(map(ids_of.get, own, repeat(RARE)), np.int64, len(own)), END))
                held += len(docs[-1])
                if held >= BLOCK_TOKENS:
                    trainer.feed(docs)
                    docs, held = [], 0
        if docs:
            trainer.feed(docs)
        if trainer.tokens:
            found, tokens = trainer.params, trainer.tokens
            yield pa.RecordBatch.from_arrays(
                [pa.array([tokens]), pa.array([b"".join((x.astype(np.float64) * tokens).tobytes() for x in found.values())], pa.binary())], names=["tokens", "weights"]
            )

    return run


def _add_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, tokens = 0.0, 0
    for batch in batches:
        tokens += sum(batch.column("tokens").to_pylist())
        for raw in batch.column("weights"):
            total = total + np.frombuffer(raw.as_py(), np.float64)
        grp = batch.column("grp").slice(0, 1)
    yield pa.RecordBatch.from_arrays([pa.array([tokens]), pa.array([total.tobytes()], pa.binary()), grp], names=["tokens", "weights", "grp"])


def train(
    spark: SparkSession, docs: DataFrame, vocab: dict[bytes, int], counts: np.ndarray, rounds: int = ROUNDS
) -> tuple[dict[str, np.ndarray], int]:
    """Weights after each of `docs` was trained on once, and the tokens trained on; each round has its own share of the documents."""
    params = init_params(len(vocab) + 2)
    start_from_counts(params, counts)
    seen = 0
    words = spark.sparkContext.broadcast(vocab)
    turn = F.pmod(F.xxhash64("doc_id", F.crc32("text"), F.lit("network")), F.lit(rounds))
    tasks = docs.rdd.getNumPartitions()
    for i in range(rounds):
        shared = spark.sparkContext.broadcast(params)
        parts = docs.where(turn == i).select("text").mapInArrow(tidy(_train_task(shared, words, 0.01 / (1 + i))), "tokens long, weights binary")
        # Sums of weights are of fixed size; a tree adds them up.
        parts, groups = parts.withColumn("grp", F.spark_partition_id()), tasks
        while groups > 1:
            groups = -(-groups // FAN_IN)
            parts = parts.withColumn("grp", F.pmod("grp", F.lit(groups))).groupBy("grp").applyInArrow(_add_weights, "tokens long, weights binary, grp int")
        with small_batches(spark, FAN_IN):
            sums = parts.collect()
        shared.destroy()
        tokens = sum(r["tokens"] for r in sums)
        if not tokens:
            continue
        seen += tokens
        flat = sum(np.frombuffer(bytes(r["weights"]), np.float64) for r in sums) / tokens
        new, at = {}, 0
        for k, v in params.items():
            new[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        params = new
    words.destroy()
    return params, seen


def _own_words(head):
    def run(table: pa.Table) -> pa.Table:
        found: set[bytes] = set()
        for text in table.column("text"):
            found.update(words_of(text.as_py()))
        found.difference_update(head.value[0])
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()] * len(found), pa.int32()), "word": pa.array(list(found), pa.binary())})

    return run


#: Buckets of counts in each octave, to find where the most frequent words begin.
STEPS_PER_OCTAVE = 16


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most `most` words of at most `HEAD_BYTES`, the most frequent first, equally frequent ones by bytes; at least `VOCAB` if there are.

    A histogram of the counts (some hundred rows) says above which count that many words lie, and only those
    are fetched; words of the count where the list ends are fetched only if fewer than `VOCAB` lie above.
    """
    short = counts.where(F.octet_length("word") <= HEAD_BYTES).withColumn("step", F.floor(F.log2("c") * STEPS_PER_OCTAVE).cast("int"))
    above, cut = 0, None
    for r in sorted(short.groupBy("step").count().collect(), key=lambda r: -r["step"]):
        if above + r["count"] > most:
            cut = r["step"]
            break
        above += r["count"]
    rows = (short.where(F.col("step") > cut) if cut is not None else short).select("word", "c").collect()
    if cut is not None and above < VOCAB:
        rows += short.where(F.col("step") == cut).orderBy(F.desc("c"), "word").limit(min(VOCAB, most) - above).select("word", "c").collect()
    return sorted(((bytes(r["word"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_chunk(params, head, vocab_size: int, total: int, distinct: int, ends: int, vocab_mass: float):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        known, known_counts = head.value  # the model's vocabulary comes first
        place = dict(known)
        place.update(zip(words.column("word").to_pylist(), range(len(known) + 1, len(known) + 1 + words.num_rows)))
        c = np.concatenate(([ends], known_counts, words.column("c").to_numpy().astype(np.float64)))
        ids = np.full(len(c), RARE, dtype=np.int64)
        ids[0], ids[1 : vocab_size + 1] = END, np.arange(2, vocab_size + 2)
        whole = total + 0.1 * (distinct + 1)
        base = np.log10((c + 0.1) / whole)
        rare = np.where(ids == RARE, np.log10((c + 0.1) / max(whole - vocab_mass, 1e-9)), 0.0)
        tokens, lens = [], []
        for text in docs.column("text"):
            own = words_of(text.as_py())
            tokens.append(np.append(np.fromiter(map(place.__getitem__, own), np.int64, len(own)), 0))
            lens.append(len(tokens[-1]))
        flat = np.concatenate(tokens)
        starts = np.cumsum(lens) - np.array(lens)
        model = score_documents(params.value, [ids[t] for t in tokens]) / np.log(10) + np.add.reduceat(rare[flat], starts)
        n = len(lens)
        return pa.table(
            {
                "doc_id": docs.column("doc_id"), "held_out": docs.column("held_out"), "n_tokens": pa.array(lens, pa.int64()),
                "n_known": pa.array(np.add.reduceat((c[flat] > 0).astype(np.int64), starts)), "train_tokens": pa.array([total] * n, pa.int64()),
                "base_score": pa.array(np.add.reduceat(base[flat], starts)), "score": pa.array(model),
            }
        )

    def safe(docs: pa.Table, words: pa.Table) -> pa.Table:
        give_back()
        if not docs.num_rows:
            return pa.table({f.split()[0]: pa.array([], t) for f, t in zip(RESULT.split(", "), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))})
        return run(docs, words)

    return safe


def score_texts(spark: SparkSession, docs: DataFrame, folds: int = 10, fold: int = 0) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words (runs of anything but ASCII white space, A-Z
    lower-cased) of the whole text and one end; null text counts as empty.
    Learns from the rows outside the fold. `base_score` is the smoothed
    unigram log10 probability, `score` the network's. Words that training
    never met have the probability of one unseen word; of words equally
    frequent the first by bytes enters the vocabulary, words of over 64 bytes
    never do. Rows that repeat count
    and score as often as they occur, and two texts of one doc_id score apart;
    null ids are in no fold and are learned from; very long texts are scored
    whole; an empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(spark, "lm-score")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    train_rows = rows.where("not held_out")
    counted = train_rows.select("text").mapInArrow(tidy(_count_words), "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
    every = scratch.keep(counted, "counts")
    counts = every.where(~F.col("word").isin([F.lit(DOCS), F.lit(CHARS)]))
    summed = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    told = {bytes(r["word"]): r["c"] for r in every.where(F.col("word").isin([F.lit(DOCS), F.lit(CHARS)])).collect()}
    ends = told.get(DOCS, 0)
    # The fold leaves out a share of the texts; the size of all only sets the number of chunks.
    chars = told.get(CHARS, 0) * folds / max(1, folds - 1) if ends else rows.agg(F.sum(F.length("text"))).first()[0] or 0
    total, distinct = summed["n"] + ends, summed["v"] + (ends > 0)
    often = most_frequent(counts, HEAD)
    top = often[:VOCAB]  # the model's vocabulary
    vocab = {w: i + 2 for i, (w, _) in enumerate(top)}
    known = sum(c for _, c in top)
    vocab_counts = np.array([ends, summed["n"] - known, *[c for _, c in top]], dtype=np.float64)
    vocab_mass = float(ends + 0.1 + known + 0.1 * len(top))
    params = spark.sparkContext.broadcast(train(spark, train_rows, vocab, vocab_counts)[0])
    counted = np.array([c for _, c in often], dtype=np.float64)
    head = spark.sparkContext.broadcast(({w: i + 1 for i, (w, _) in enumerate(often)}, counted))

    chunks = max(1, int(chars // CHUNK_CHARS) + 1)
    # Several times as many partitions as chunks, so that few chunks share one.
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", F.crc32("text")), F.lit(chunks)).cast("int")).repartition(4 * chunks, "chunk")
    asked = dealt.groupBy("chunk").applyInArrow(_own_words(head), "chunk int, word binary")  # the same columns, so texts are dealt once
    told = asked.join(counts, "word", "left").select("chunk", "word", F.coalesce("c", F.lit(0)).alias("c"))
    scorer = _score_chunk(params, head, len(vocab), int(total), int(distinct), int(ends), vocab_mass)
    return dealt.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(scorer, RESULT)
