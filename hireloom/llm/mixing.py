"""Mixing sources to target weights by pivotal dependent rounding.

A source's share of all words is its target; every document of the source gets
the same expected number of copies, target / size of the source. The whole part of
it is certain. The fractional part is a copy probability, and probabilities are
settled in pairs: the pair shifts words from one to the other, in a random
direction that keeps both expectations, until one of the two is 0 or 1. The
sum of words never changes, so what a source misses its target by is the
rounding of one last document, and other documents of the root take that up.

Pairs meet inside groups of a source (hash buckets of bounded size); each group leaves
at most one unsettled document, and those meet again in a tree of the same
reduction. No task sees more than one group's documents, however large the source is.
Draws are hashes of the document and a seed, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, n_words

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3.0
GROUP = 4096
FAN_IN = 256
#: Twice so many documents of a source's root group are tried in all combinations.
HALF = 12


def source_targets(spark: SparkSession, sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, docs, target) for (source, source_size, docs).

    Sources in code-point order, null last, take the weights in turn. Shares
    that exceed `max_repeat` times their source are cut there and the excess
    is dealt again by weight until none is above.
    """
    from pyspark.sql import Window as W

    # One row per source: the only global order here, and as long as the list of sources.
    order = W.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    ranked = ranked.withColumn("most", F.col("source_size") * F.lit(float(max_repeat)))
    ranked = Scratch(spark, "mixing").keep(ranked, "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        # Words per unit of weight once the sources that are full at this level are set aside.
        full = F.col("most") <= F.col("weight") * F.lit(level)
        r = ranked.agg(
            F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)).alias("set_aside"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        if r["open"] == 0:
            break
        new = (total - r["set_aside"]) / r["open"]
        if new <= level * (1 + 1e-12):
            break
        level = new
    return ranked.select("source", "source_size", "docs", F.least("most", F.col("weight") * F.lit(level)).alias("target"))


def settle(share: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Pivotal rounding in the given order; at most one share stays fractional.

    `draw` holds a uniform number per document. The document carried along
    meets the next one; the words they hold together stay the same.
    """
    out = share.tolist()
    sizes, draws = size.tolist(), draw.tolist()
    held = -1
    for j, x in enumerate(out):
        if not 0.0 < x < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, sizes[held], sizes[j]
        words_i, words_j = out[i] * a, x * b
        up = min(a - words_i, words_j)  # from j to i
        down = min(words_i, b - words_j)  # from i to j
        if draws[j] * (up + down) < down:
            i_done, j_done = up == a - words_i, up == words_j
            words_i, words_j = words_i + up, words_j - up
            out[i], out[j] = (1.0 if i_done else words_i / a), (0.0 if j_done else words_j / b)
        else:
            i_done, j_done = down == words_i, down == b - words_j
            words_i, words_j = words_i - down, words_j + down
            out[i], out[j] = (0.0 if i_done else words_i / a), (1.0 if j_done else words_j / b)
        held = -1 if i_done and j_done else (j if i_done else i)
    return np.array(out)


def absorb(share: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Round the one open share by its draw and let settled documents take up the words that it misses.

    The open document may be large, so its rounding may miss many words. Few documents are
    tried in all combinations; of more, single ones and pairs change sides as long as that brings the sum nearer.
    """
    out = share.copy()
    at = np.flatnonzero((share > 0) & (share < 1))
    if not len(at):
        return out
    i = at[0]
    out[i] = float(draw[i] < share[i])
    miss = (share[i] - out[i]) * size[i]  # words still to take, or taken too many
    free = np.flatnonzero(size > 0)
    gain = np.where(out[free] > 0.5, -size[free], size[free])  # words that a change of sides adds
    for k in _nearest(gain, miss):
        out[free[k]] = 1.0 - out[free[k]]
    return out


def _sums(gain: np.ndarray) -> np.ndarray:
    """Sums of all subsets; bit k of a place stands for number k."""
    sums = np.zeros(1)
    for g in gain:
        sums = np.concatenate([sums, sums + g])
    return sums


def _best_subset(gain: np.ndarray, miss: float) -> list[int]:
    """The numbers of at most `2 * HALF` whose sum is nearest to `miss`: all subsets of one half meet those of the other."""
    left, right = _sums(gain[:HALF]), _sums(gain[HALF:])
    # Of equally good choices one that changes few.
    by = np.lexsort((np.bitwise_count(np.arange(len(right))), right))
    ranked = right[by]
    spot = np.searchsorted(ranked, miss - left)
    tries = [np.clip(spot - 1, 0, len(ranked) - 1), np.clip(spot, 0, len(ranked) - 1)]
    far = np.concatenate([np.abs(miss - left - ranked[t]) for t in tries])
    changes = np.concatenate([np.bitwise_count(np.arange(len(left))) + np.bitwise_count(by[t]) for t in tries])
    best = int(np.lexsort((changes, np.round(far, 6)))[0])
    one, other = best % len(left), int(by[tries[best // len(left)][best % len(left)]])
    return [k for k in range(len(gain)) if (one >> k if k < HALF else other >> (k - HALF)) & 1]


def _nearest(gain: np.ndarray, miss: float) -> list[int]:
    """Numbers of `gain` whose sum is near to `miss`: the best for up to `2 * HALF`, else by steps of one or two and then the smallest ones."""
    if len(gain) <= 2 * HALF:
        return _best_subset(gain, miss)
    chosen = np.zeros(len(gain), bool)
    while abs(miss) > 0:
        now = np.where(chosen, -gain, gain)
        order = np.argsort(now, kind="stable")
        # The best partner of each number is the one nearest to what is left; number 0 stands for none.
        value = np.concatenate([[0.0], now[order]])
        by = np.argsort(value, kind="stable")
        ranked = value[by]
        want = miss - ranked
        spot = np.clip(np.searchsorted(ranked, want), 1, len(ranked) - 1)
        tries = np.stack([np.abs(ranked[spot - 1] - want), np.abs(ranked[spot] - want)])
        other = np.where(tries[0] <= tries[1], spot - 1, spot)
        far = np.minimum(tries[0], tries[1])
        far[other == np.arange(len(ranked))] = np.inf  # not twice the same
        k = int(np.argmin(far))
        if not far[k] < abs(miss) - 1e-9:
            break
        for j in (by[k], by[other[k]]):
            if j:
                chosen[order[j - 1]] ^= True
        miss -= ranked[k] + ranked[other[k]]
    small = np.argsort(np.abs(gain), kind="stable")[: 2 * HALF]
    for k in _best_subset(np.where(chosen, -gain, gain)[small], miss):
        chosen[small[k]] ^= True
    return np.flatnonzero(chosen).tolist()


def _settle_group(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw", "row_key"], ascending=[False, True, True], kind="stable")
        size, draw = pdf["size"].to_numpy(dtype=np.float64), pdf["draw"].to_numpy()
        share = settle(pdf["share"].to_numpy(), size, draw)
        return pdf.assign(share=absorb(share, size, draw) if last else share)

    return run


SHARE_SCHEMA = "row_key string, source string, size long, share double, draw double, grp long"


def settle_shares(scratch: Scratch, shares: DataFrame, largest: int) -> DataFrame:
    """Round the shares of every source to 0 or 1: (row_key, share).

    `shares` has a row per document: row_key, source, size, share, draw, and
    grp, its group within the source; `largest` is the number of groups of the
    largest source.
    """
    # One group of every source waits for the root, so that small documents are still there.
    settled, groups = [], largest
    open_, root = shares.where("grp > 0"), shares.where("grp = 0")
    while groups > 1:
        done = scratch.keep(open_.groupBy("source", "grp").applyInPandas(_settle_group(False), SHARE_SCHEMA), "settled")
        settled.append(done.where("share <= 0 or share >= 1"))
        groups = -(-groups // FAN_IN)
        open_ = done.where("share > 0 and share < 1").withColumn("grp", F.pmod(F.col("grp"), F.lit(groups)))
    if largest > 1:
        root = root.unionByName(open_)
    settled.append(scratch.keep(root.groupBy("source").applyInPandas(_settle_group(True), SHARE_SCHEMA), "root"))
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("row_key", "share")


def _plan(spark: SparkSession, docs: DataFrame, weights, max_repeat: float, seed: int) -> tuple[Scratch, DataFrame]:
    """(doc_id, text_key, turn, turns, size, source, source_size, target, copies) per row of `docs`."""
    scratch = Scratch(spark, "mixing")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["source"].cast("string").alias("source"),
        n_words(docs["text"]).alias("size"),
        F.xxhash64(docs["text"]).alias("text_key"),
    )
    # Rows that repeat are one entry each; a number tells them apart.
    from pyspark.sql import Window as W

    same = W.partitionBy("doc_id", "text_key", "source")
    rows = rows.withColumn("turn", F.row_number().over(same.orderBy("size"))).withColumn("turns", F.count("*").over(same))
    rows = rows.withColumn("row_key", F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex("text_key"), "turn", F.hex(F.xxhash64("source"))))
    rows = scratch.keep(rows, "sizes")
    targets = scratch.keep(
        source_targets(spark, rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), weights, max_repeat), "targets"
    )
    most = targets.agg(F.max("docs")).first()[0] or 0
    joined = rows.join(targets, rows["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeat)))).otherwise(0.0)
    draw = F.shiftrightunsigned(F.xxhash64("row_key", F.lit(seed)), 11) / F.lit(float(1 << 53))
    joined = joined.withColumn("whole", F.floor(rate)).withColumn("part", rate - F.floor(rate))
    shares = joined.where("size > 0 and part > 0").select(
        "row_key", "source", "size", F.col("part").alias("share"), draw.alias("draw"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "row_key"), F.ceil(F.col("docs") / F.lit(GROUP))).alias("grp"),
    )
    rounded = settle_shares(scratch, shares, -(-most // GROUP))
    out = joined.join(rounded, "row_key", "left").withColumn(
        "copies", F.when(F.col("size") > 0, (F.col("whole") + F.coalesce("share", F.lit(0.0))).cast("int")).otherwise(0)
    )
    return scratch, out.select("doc_id", "text_key", "turn", "turns", "source", "size", "source_size", "target", "copies")


def mix_sources(
    spark: SparkSession, docs: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 20_240
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    Size counts words (null text: 0). `taken` is copies times size: the words
    that the mix takes of the document. Documents without words are never
    taken; sources without words get the target 0; null sources are one source,
    the last; null ids are values like others; rows that repeat are drawn one
    by one; of documents equal in size and draw the first by name meets first. Whole
    texts are counted, however long. An empty table gives an empty result. Other
    columns are not read.
    """
    _, plan = _plan(spark, docs, weights, max_repeat, seed)
    return plan.select(
        "doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies"
    )


def take_mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 20_240) -> DataFrame:
    """`docs` as the mix takes it: every row as often as it has copies, all columns as they were.

    Null ids and null sources are values like others (null sources are the
    last source); rows without words, null and empty texts too, are never
    taken. Rows that repeat are interchangeable and share their copies. Whole
    texts count, however long. An empty table gives an empty result, and
    columns of any name are carried through.
    """
    from pyspark.sql import Window as W

    scratch, plan = _plan(spark, docs, weights, max_repeat, seed)
    many = plan.where("copies > 0").groupBy("doc_id", "text_key", "source").agg(F.sum("copies").cast("int").alias("copies"), F.max("turns").alias("turns"))
    many = scratch.keep(many.select(F.col("doc_id").alias("id"), "text_key", F.col("source").alias("of"), "copies", "turns"), "copies")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, docs["doc_id"].cast("long").alias("row_id"), F.xxhash64(docs["text"]).alias("row_text"), docs["source"].cast("string").alias("row_source"))
    same = F.col("row_id").eqNullSafe(F.col("id")) & (F.col("row_text") == F.col("text_key")) & F.col("row_source").eqNullSafe(F.col("of"))
    # The join has dealt the rows by their key already, so numbering those that repeat moves nothing.
    nth = F.row_number().over(W.partitionBy("row_id", "row_text", "row_source").orderBy("copies"))
    joined = rows.join(many, same).withColumn("nth", nth)
    times = F.floor(F.col("copies") / F.col("turns")) + F.when(F.col("nth") <= F.col("copies") % F.col("turns"), 1).otherwise(0)
    return joined.withColumn("times", times.cast("int")).where("times > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select("doc.*")
