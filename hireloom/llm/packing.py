"""Best-fit packing of token sequences by large-item matching.

Pieces longer than a third of the capacity fit at most twice into a sequence:
they are matched greedily, the longest with the longest partner that fits.
Shorter pieces then go, longest first, into the gap that they leave smallest,
and open new sequences where no gap is left.

Pieces of one length are interchangeable, so the plan is made for the counts
of the lengths (at most `capacity` numbers, whatever the data) and says which
ranks of a length go where. Every piece finds its place by its rank, so no
task ever holds more than its own pieces.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, tidy
from .tokens import encoder, tokenizer_path

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
RANK_BUCKETS = 256


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            doc_ids = batch.column(0).to_pylist()
            for doc_id, raw in ((d, x.as_py()) for at, part in enc.encode_all(batch.column(1), end) for d, x in zip(doc_ids[at:], part)):
                ids = np.frombuffer(raw, enc.dtype).astype("<u4").tobytes()
                n = len(ids) // 4
                for piece, start in enumerate(range(0, n, capacity)):
                    part = ids[4 * start : 4 * (start + capacity)]
                    rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part)))
            if rows:
                cols = list(zip(*rows))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Places for pieces of each length: (length, first rank, end rank, sequence of the first, offset).

    Rank r of a row goes to sequence `sequence + r - first rank` at `offset`.
    """
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    used = [0] * (capacity + 1)  # ranks given out by length
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]
    places: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(length: int, m: int, sequence: int, room: int) -> None:
        places.append((length, used[length], used[length] + m, sequence, capacity - room))
        used[length] += m
        left[length] -= m

    def leave(room: int, sequence: int, m: int) -> None:
        if room and m:
            gaps.setdefault(room, []).append((sequence, m))

    third = capacity // 3
    for a in range(capacity, third, -1):
        while left[a]:
            b = min(a, capacity - a)
            while b > third and (left[b] < 2 if b == a else not left[b]):
                b -= 1
            if b <= third:
                m = left[a]
                put(a, m, sequences, capacity)
                leave(capacity - a, sequences, m)
            else:
                m = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, m, sequences, capacity)
                put(b, m, sequences, capacity - a)
                leave(capacity - a - b, sequences, m)
            sequences += m
    for a in range(third, 0, -1):
        room = a
        while left[a]:
            while room < capacity and not gaps.get(room):
                room += 1
            if room < capacity:
                first, m = gaps[room].pop()
            else:
                first, m = sequences, max(1, left[a] // (capacity // a))
                sequences += m
            each = min(room // a, left[a])
            take = min(m, left[a] // each)
            for k in range(each):
                put(a, take, first, room - k * a)
            leave(room - each * a, first, take)
            if take < m:
                gaps.setdefault(room, []).append((first + take, m - take))
    return places


def _place(places: list[tuple[int, int, int, int, int]]):
    table = np.array(sorted(places), dtype=np.int64).reshape(-1, 5)
    shift = np.int64(1 << 48)
    keys = table[:, 0] * shift + table[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank"))
            at = np.searchsorted(keys, length * shift + rank, side="right") - 1
            cols = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            cols["sequence_id"] = pa.array(table[at, 3] + rank - table[at, 1])
            cols["offset"] = pa.array(table[at, 4])
            yield pa.RecordBatch.from_pydict(cols)

    return run


def pack_pieces(scratch: Scratch, pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to (doc_id, piece, start, length, ids_crc32) rows that were written."""
    # Pieces that fill a sequence have one of their own, with a number below zero; the rest find theirs by rank.
    whole = pieces.where(F.col("length") == capacity)
    whole = whole.select(*pieces.columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    keyed = pieces.where(F.col("length") < capacity).withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(RANK_BUCKETS)).cast("int"))
    counts = keyed.groupBy("length", "__bucket").agg(F.count("*").alias("__n"))
    before = W.partitionBy("length").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = scratch.keep(counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))), "lengths")
    totals = {r[0]: r[1] for r in bases.groupBy("length").agg(F.sum("__n")).collect()}  # at most `capacity` rows
    within = F.row_number().over(W.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = (
        keyed.withColumn("__rank", within)
        .join(bases.select("length", "__bucket", "__base"), ["length", "__bucket"])
        .withColumn("__rank", (F.col("__rank") + F.col("__base")).cast("long"))
        .select("doc_id", "piece", "start", "length", "ids_crc32", "__rank")
    )
    return whole.unionByName(ranked.mapInArrow(_place(plan(totals, capacity)), PIECE_SCHEMA + ", sequence_id long, offset long"))


def pack_documents(
    spark: SparkSession, docs: DataFrame, capacity: int = 2048, end_id: int = 0, tokenizer: str | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the token ids of its whole text (null: empty) and `end_id`.
    Only documents longer than `capacity` are cut, into pieces of `capacity`
    and a rest. Every document has at least its end, so even an empty one has
    a piece; rows that repeat are packed as often as they occur; null ids are
    kept; pieces of one length are interchangeable and ordered by id, place and
    crc; a very long text gives as many pieces as it fills; an empty table gives
    an empty result. Other columns are not read.
    """
    scratch = Scratch(spark, "packing")
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    pieces = source.mapInArrow(tidy(_pieces(tokenizer or tokenizer_path(), capacity, end_id)), PIECE_SCHEMA)
    return pack_pieces(scratch, scratch.keep(pieces, "pieces"), capacity)
