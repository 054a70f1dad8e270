"""Hard-negative mining by a two-dimensional block matrix multiply.

Rows are cut into blocks of a bounded number of cells and dimensions into
chunks. Every (anchor block, row block, chunk) is one product whose partial
int64 score tile is shuffled to the tile's key and added there (a single chunk
is a finished tile where it is made). A finished tile keeps its best few rows
for each anchor (first walk: positives) or for each anchor-positive window
(second walk: negatives), and the tiles' bests are reduced by anchor. Nothing
is sampled, and no task holds more than two blocks and a strip of their tile.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, running_total, small_batches, tidy

#: Anchors and rows of a block, dimensions of a chunk, and anchors that are multiplied at a time.
ANCHORS, ROWS, WIDTH, STRIP = 2_048, 4_096, 64, 256
#: Products below this bound are exact in double precision.
EXACT = 1 << 53

BLOCK = "block long, chunk int, ids binary, labels binary, spots binary, vectors binary"
PARTIAL = "ablock long, strip int, rblock long, aids binary, alabels binary, aspots binary, windows binary, ids binary, labels binary, spots binary, tile binary"
BEST = "anchor long, spot long, other long, positive int, positive_score long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): rows that take part, with the changed label and components floor(256 * x) as long."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False))).select(
        F.col("vec_id").cast("long"), label.cast("long").alias("label"), F.transform(x, lambda v: F.floor(v.cast("double") * 256)).alias("q")
    )


def _pack(width: int, chunks: int):
    """Rows of one block to one record a chunk; within a block rows are in the order of their ids."""

    def run(key, table):
        table = table.sort_by([("vec_id", "ascending"), ("spot", "ascending")])
        column = table.column("q").combine_chunks()
        lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        whole = np.zeros((len(lengths), width * chunks), np.int64)  # missing dimensions of a shorter vector count as 0
        at = np.repeat(np.arange(len(lengths)), lengths)
        whole[at, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
        ids, labels, spots = (table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label", "spot"))
        out = [(key[0].as_py(), c, ids, labels, spots, np.ascontiguousarray(whole[:, c * width : (c + 1) * width]).tobytes()) for c in range(chunks)]
        names = [f.split()[0] for f in BLOCK.split(", ")]
        types = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        return pa.table({n: pa.array([r[i] for r in out], t) for i, (n, t) in enumerate(zip(names, types))})

    return run


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int64; in double precision where its bound proves that exact."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound >= 1 << 62:
        raise ValueError("inner products of these vectors pass 64 bits")
    return a @ b.T


def _longs(raw) -> np.ndarray:
    return np.frombuffer(raw, np.int64)


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in ddl.split(", ")])


def _strips(r: dict, width: int, same: bool, positives: int):
    """Partial tiles of two joined blocks, a strip of anchors at a time; strips without a pair to score (by labels) are not made."""
    ids, labels, spots = (_longs(r[c]) for c in ("ids", "labels", "spots"))
    aids, alabels, aspots = (_longs(r[c]) for c in ("aids", "alabels", "aspots"))
    mine, theirs = _longs(r["avectors"]).reshape(-1, width), _longs(r["vectors"]).reshape(-1, width)
    windows = None if same else _longs(r["windows"]).reshape(len(aids), positives, 2)
    for strip, lo in enumerate(range(0, len(aids), STRIP)):
        cut = slice(lo, lo + STRIP)
        if not np.isin(alabels[cut], labels).any() if same else len(np.union1d(alabels[cut], labels)) == 1:
            continue
        yield strip, exact_product(mine[cut], theirs), (aids[cut], alabels[cut], aspots[cut]), None if same else windows[cut], (ids, labels, spots)


def _best(tile: np.ndarray, anchors, windows, rows, k: int) -> pa.RecordBatch:
    """The best `k` rows of each anchor in a finished tile (no windows: rows of its label), or of each of its windows (rows of other labels)."""
    (aids, alabels, aspots), (ids, labels, spots) = anchors, rows
    out: dict[str, list] = {n: [] for n in _names(BEST)}

    def put(i, places, positive, ps):
        n = len(places)
        values = (np.full(n, aspots[i]), spots[places], ids[places], np.full(n, positive), np.full(n, ps), tile[i, places])
        for name, value in zip(out, values):
            out[name].append(value)

    for i in range(len(aids)):
        if windows is None:
            places = np.flatnonzero((labels == alabels[i]) & (spots != aspots[i]))
        else:
            held = windows[i][windows[i][:, 1] > 0]
            if not len(held):
                continue
            places = np.flatnonzero((labels != alabels[i]) & (tile[i] >= -(-80 * int(held[:, 0].min()) // 100)))
        places = places[np.argsort(-tile[i, places], kind="stable")]  # ties stay in the order of ids
        if windows is None:
            put(i, places[:k], 0, 0)
            continue
        falling = -tile[i, places]
        for p, (ps, there) in enumerate(windows[i]):
            if there:
                lo = np.searchsorted(falling, -ps, "left")
                hi = np.searchsorted(falling, 80 * int(ps) // -100, "right")
                put(i, places[lo : max(lo, min(hi, lo + k))], p, ps)
    arrays = [pa.array(np.concatenate(v) if v else [], _arrow(BEST).field(n).type) for n, v in out.items()]
    return pa.RecordBatch.from_arrays(arrays, schema=_arrow(BEST))


def _whole_tiles(width: int, same: bool, positives: int, k: int):
    """Where one chunk holds all dimensions a product is a finished tile: it is reduced where it was made."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for _, tile, anchors, windows, rows in _strips(r, width, same, positives):
                    yield _best(tile, anchors, windows, rows, k)

    return tidy(run)


def _partial_tiles(width: int, same: bool, positives: int):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                for strip, tile, anchors, windows, rows in _strips(r, width, same, positives):
                    one = {"ablock": r["ablock"], "strip": strip, "rblock": r["rblock"], "tile": tile.tobytes()}
                    if r["chunk"] == 0:  # what describes the tile travels once
                        one |= dict(zip(("aids", "alabels", "aspots", "ids", "labels", "spots"), (v.tobytes() for v in (*anchors, *rows))))
                        one["windows"] = None if windows is None else np.ascontiguousarray(windows).tobytes()
                    yield pa.RecordBatch.from_pylist([one], schema=_arrow(PARTIAL))

    return tidy(run)


def _add_tiles(same: bool, positives: int, k: int):
    """Add the partial tiles of a key, then reduce the sum."""

    def run(table):
        total = head = None
        for batch in table.to_batches(1):
            r = batch.to_pylist()[0]
            part = _longs(r["tile"])
            total = part.copy() if total is None else np.add(total, part, out=total)
            head = r if r["ids"] is not None else head
        anchors = [_longs(head[c]) for c in ("aids", "alabels", "aspots")]
        rows = [_longs(head[c]) for c in ("ids", "labels", "spots")]
        windows = None if same else _longs(head["windows"]).reshape(-1, positives, 2)
        return pa.Table.from_batches([_best(total.reshape(len(anchors[0]), -1), anchors, windows, rows, k)])

    return run


def _tiles(anchors: DataFrame, rows: DataFrame, n_a: int, n_r: int, width: int, chunks: int, same: bool, positives: int, k: int) -> DataFrame:
    """Best rows of every tile. Each block goes to the tiles that need it: rows once per anchor block and anchors once per row block."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = anchors.select(F.col("block").alias("ablock"), "chunk", *[F.col(c).alias(f"a{c}") for c in ("ids", "labels", "spots", "vectors")], "windows")
    left = left.withColumn("rblock", upto(n_r))
    right = rows.withColumnRenamed("block", "rblock").withColumn("ablock", upto(n_a))
    joined = left.join(right.hint("shuffle_hash"), ["ablock", "rblock", "chunk"])
    if chunks == 1:
        return joined.mapInArrow(_whole_tiles(width, same, positives, k), BEST)
    parts = joined.mapInArrow(_partial_tiles(width, same, positives), PARTIAL)
    return parts.groupBy("ablock", "strip", "rblock").applyInArrow(_add_tiles(same, positives, k), BEST)


def hard_negatives(
    spark: SparkSession, vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5,
    anchors_per_tile: int = ANCHORS, rows_per_tile: int = ROWS, width: int = WIDTH,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, embedding, label).

    Anchors are rows whose vec_id `every` divides; the scores, the windows and
    the order are those of `op13`. Rows without id, label or vector, or with a
    null or non-finite component, take no part. Repeated rows each count (a copy
    of an anchor is one of its possible positives); rows alike in id and score
    may stand for each other. Shorter vectors count as padded by zeros, empty
    ones score 0. Products past 64 bits are an error. An empty table, or one
    without anchors or rivals, gives no rows; other columns are ignored.
    """
    scratch = Scratch(spark, "hard-negatives")
    rows = scratch.keep(usable(vectors).withColumn("one", F.lit(1)), "rows")
    size = rows.agg(F.count("*"), F.max(F.size("q")), F.sum((F.col("vec_id") % every == 0).cast("long"))).first()
    n, dims, n_anchors = size[0] or 0, max(size[1] or 0, 1), size[2] or 0
    width = min(width, dims)
    chunks = -(-dims // width)
    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    spotted = scratch.keep(running_total(scratch, rows, ["label", "vec_id"], "one", "spot"), "spotted")
    asked = running_total(scratch, spotted.where(F.col("vec_id") % every == 0), ["spot"], "one", "nth")

    def blocks(df, spot, per, name):
        cut = df.withColumn("block", F.floor(F.col(spot) / per)).select("block", "vec_id", "label", "spot", "q")
        return scratch.keep(cut.groupBy("block").applyInArrow(_pack(width, chunks), BLOCK), name)

    row_blocks = blocks(spotted, "spot", rows_per_tile, "row-blocks")
    asked = scratch.keep(asked, "anchors")
    anchor_blocks = blocks(asked, "nth", anchors_per_tile, "anchor-blocks")
    n_r, n_a = -(-n // rows_per_tile), -(-n_anchors // anchors_per_tile)

    with small_batches(spark, 2):
        first = _tiles(anchor_blocks.withColumn("windows", F.lit(None).cast("binary")), row_blocks, n_a, n_r, width, chunks, True, positives, positives)
        near = scratch.keep(first, "near")
        by_anchor = W.partitionBy("anchor").orderBy(F.desc("score"), "other", "spot")
        chosen = near.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives)
        chosen = scratch.keep(chosen.select("anchor", F.col("place").cast("int"), F.col("other").alias("positive_id"), F.col("score").alias("ps")), "positives")

        # The windows of an anchor block travel with its blocks: `positives` pairs (score, there) an anchor, in the block's order.
        windows = (
            asked.select(F.col("spot").alias("anchor"), F.floor(F.col("nth") / anchors_per_tile).alias("block"), "vec_id")
            .join(chosen.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "ps"))).alias("w")), "anchor", "left")
            .groupBy("block").applyInArrow(_window_bytes(positives), "block long, windows binary")
        )
        second = _tiles(anchor_blocks.join(windows, "block"), row_blocks, n_a, n_r, width, chunks, False, positives, negatives)
        found = scratch.keep(second, "negatives")
    by_pair = W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other", "spot")
    best = found.withColumn("rank", F.row_number().over(by_pair)).where(F.col("rank") <= negatives)
    names = asked.select(F.col("spot").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    pairs = chosen.select("anchor", (F.col("place") - 1).alias("positive"), "positive_id")
    return best.join(pairs, ["anchor", "positive"]).join(names, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _window_bytes(positives: int):
    def run(key, table):
        table = table.sort_by([("vec_id", "ascending"), ("anchor", "ascending")])
        out = np.zeros((table.num_rows, positives, 2), np.int64)
        for i, held in enumerate(table.column("w").to_pylist()):
            for p, one in enumerate(held or ()):
                out[i, p] = one["ps"], 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "windows": pa.array([out.tobytes()], pa.binary())})

    return run


SQL = """
    WITH valid AS MATERIALIZED (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS MATERIALIZED (
        SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
               list_inner_product(a.q, b.q)::BIGINT AS score
        FROM valid a JOIN valid b ON a.vec_id <> b.vec_id
        WHERE a.vec_id % 100 = 0
    ), positive AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT p.anchor_id, p.positive_id,
           row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
           s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
    FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
     AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
    QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""
