"""Exact dedup with a log-structured merge index over text digests.

Every map task fills a memtable of (digest, identifier) and flushes it as
sorted runs without repeats, one per index shard, each with a Bloom filter. A shard's task
compacts its runs tier by tier; equal digests meet there and the smallest
identifier stays. Digests that stand for more than one row are *hits*, and the
texts of hits are compared byte for byte: the smallest and the largest text of
a digest must be one, and both are found with a partial sum in the map tasks.

Copies collapse in the memtables before anything is shuffled, so a group that
holds a third of all rows costs a shard one entry per memtable, and its texts
cost the check one text per map task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, split_by_key

MEMTABLE_ROWS = 262_144
SHARD_ROWS = 1_000_000
#: Groups that hold at least this share of all rows are named to every task; there are at most as many as this goes into 1.
HOT_SHARE = 1 / 10_000
FILTER_BITS_PER_KEY = 10
FILTER_HASHES = 4
TIER = 4

RUN_SCHEMA = "shard int, digests binary, idents binary, known binary, counts binary, filter binary"
ENTRY_SCHEMA = "digest binary, ident long, n long"


class Run:
    """A sorted run: digests without repeats; of each the smallest identifier, the rows that have one, and all its rows."""

    __slots__ = ("digests", "idents", "known", "counts", "filter")

    def __init__(self, digests, idents, known, counts, filter_=None):
        self.digests, self.idents, self.known, self.counts = digests, idents, known, counts
        self.filter = bloom(digests) if filter_ is None else filter_


def _words(digests: np.ndarray) -> np.ndarray:
    return digests.view(np.uint64).reshape(len(digests), -1)


def bloom(digests: np.ndarray) -> np.ndarray:
    """Bloom filter of a run; the 64-bit words of a SHA-256 digest serve as its hashes."""
    bits = 1 << max(6, int(np.ceil(np.log2(max(1, len(digests)) * FILTER_BITS_PER_KEY))))
    flags = np.zeros(bits, dtype=bool)
    words = _words(digests)
    for k in range(FILTER_HASHES):
        flags[words[:, k] & np.uint64(bits - 1)] = True
    return np.packbits(flags, bitorder="little")


def may_contain(filter_: np.ndarray, digests: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(filter_) * 8 - 1)
    found = np.ones(len(digests), dtype=bool)
    words = _words(digests)
    for k in range(FILTER_HASHES):
        bit = words[:, k] & mask
        found &= (filter_[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return found


def flush(digests: np.ndarray, idents: np.ndarray, has: np.ndarray | None = None) -> Run:
    """Memtable to run: sort, keep the smallest identifier of a digest, count rows. `has`: which identifiers aren't null."""
    has = np.ones(len(digests), bool) if has is None else has
    order = np.lexsort((idents, ~has, digests))
    digests, idents, has = digests[order], idents[order], has[order]
    first = np.flatnonzero(np.concatenate(([True], digests[1:] != digests[:-1])))
    counts = np.diff(np.append(first, len(digests)))
    return Run(digests[first], idents[first], np.add.reduceat(has.astype(np.int64), first), counts.astype(np.int64))


def merge(a: Run, b: Run) -> Run:
    """Merge two runs; only keys that the other run's filter lets through are searched there."""
    if len(a.digests) < len(b.digests):
        a, b = b, a
    same = np.full(len(b.digests), -1, dtype=np.int64)
    maybe = np.flatnonzero(may_contain(a.filter, b.digests))
    if len(maybe):
        at = np.minimum(np.searchsorted(a.digests, b.digests[maybe]), len(a.digests) - 1)
        equal = a.digests[at] == b.digests[maybe]
        same[maybe[equal]] = at[equal]
    hit, new = np.flatnonzero(same >= 0), np.flatnonzero(same < 0)
    idents, known, counts = a.idents.copy(), a.known.copy(), a.counts.copy()
    here, theirs = same[hit], b.idents[hit]
    # An identifier counts only where a row has one.
    smaller = np.where(known[here] == 0, theirs, np.where(b.known[hit] == 0, idents[here], np.minimum(idents[here], theirs)))
    idents[here] = smaller
    known[here] += b.known[hit]
    counts[here] += b.counts[hit]
    place = np.searchsorted(a.digests, b.digests[new])
    both = ((a.digests, b.digests), (idents, b.idents), (known, b.known), (counts, b.counts))
    return Run(*(np.insert(x, place, y[new]) for x, y in both))


def compact(runs: list[Run]) -> Run:
    """Size-tiered compaction: `TIER` runs of a tier become one of the next, then all that is left."""
    tiers: dict[int, list[Run]] = {}
    for run in runs:
        level = 0
        tiers.setdefault(0, []).append(run)
        while len(tiers[level]) == TIER:
            full = tiers.pop(level)
            merged = full[0]
            for other in full[1:]:
                merged = merge(merged, other)
            level += 1
            tiers.setdefault(level, []).append(merged)
            tiers.setdefault(level - 1, [])
    left = [r for level in sorted(tiers) for r in tiers[level]]
    merged = left[0]
    for other in left[1:]:
        merged = merge(other, merged)
    return merged


def _flush_partition(shards: int):
    def run(batches):
        held, rows = [], 0

        def out():
            table = flush(*(np.concatenate(x) for x in zip(*held)))
            shard = (_words(table.digests)[:, 0] % np.uint64(shards)).astype(np.int64)
            records = []
            for s in np.unique(shard):
                at = np.flatnonzero(shard == s)
                part = Run(table.digests[at], table.idents[at], table.known[at], table.counts[at])
                records.append((int(s), *(x.tobytes() for x in (part.digests, part.idents, part.known, part.counts, part.filter))))
            cols = list(zip(*records))
            names = [f.split()[0] for f in RUN_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(1)
            held.append((np.array(batch.column(0).to_pylist(), dtype="S32"), ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)))
            rows += batch.num_rows
            if rows >= MEMTABLE_ROWS:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return run


def _compact_shard(table: pa.Table) -> pa.Table:
    kinds = ("S32", np.int64, np.int64, np.int64, np.uint8)
    columns = (table.column(x).to_pylist() for x in ("digests", "idents", "known", "counts", "filter"))
    done = compact([Run(*(np.frombuffer(raw, kind) for raw, kind in zip(row, kinds))) for row in zip(*columns)])
    raw = done.digests.tobytes()
    return pa.table(
        {
            "digest": pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
            "ident": pa.array(done.idents, mask=done.known == 0),
            "n": pa.array(done.counts),
        }
    )


def build_index(keyed: DataFrame, shards: int) -> DataFrame:
    """LSM index of (digest binary, ident long) rows: one entry (digest, ident, n) per digest.

    `ident` of an entry is the smallest of its rows; null if none has one.
    """
    runs = keyed.select("digest", "ident").mapInArrow(_flush_partition(shards), RUN_SCHEMA)
    return runs.groupBy("shard").applyInArrow(_compact_shard, ENTRY_SCHEMA)


def _ident(doc_id: Column, keep: str) -> Column:
    """Identifiers order so that the smallest is the row to keep; complementing one twice gives it back."""
    return F.bitwise_not(doc_id.cast("long")) if keep == "largest" else doc_id.cast("long")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


class Found:
    """The index of a table's texts: `rows` (doc_id, digest, ident), `entries` and the `hits` among them."""

    def __init__(self, spark: SparkSession, docs: DataFrame, keep: str):
        self.scratch = Scratch(spark, "exact-dedup")
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), _digest(docs["text"]).alias("digest"), _ident(docs["doc_id"], keep).alias("ident"))
        self.rows = self.scratch.keep(rows, "rows")
        self.n = self.rows.count()
        shards = max(spark.sparkContext.defaultParallelism, -(-self.n // SHARD_ROWS))
        self.entries = self.scratch.keep(build_index(self.rows, shards), "index")
        self.hits = self.entries.where("n > 1").select("digest", F.col("ident").alias("keep"), "n")

    def verify(self, docs: DataFrame) -> None:
        """Compare the texts of hits byte for byte.

        Raises ValueError if two different texts share a digest; no such pair of
        texts is known for SHA-256, and none would be merged silently.
        """
        keyed = docs.select(F.coalesce(docs["text"], F.lit("")).alias("text"), _digest(docs["text"]).alias("digest"))
        suspects, _ = split_by_key(keyed, self.hits, ["digest"])
        apart = suspects.groupBy("digest").agg(F.min("text").alias("least"), F.max("text").alias("most")).where("least != most")
        if apart.count():
            raise ValueError("two different texts have the same SHA-256 digest")

    def grouped(self) -> DataFrame:
        """`rows` with keep and n of their group; null for texts that occur once."""
        hot = self.hits.where(F.col("n") >= F.lit(max(2, int(self.n * HOT_SHARE)))).select("digest", F.col("keep").alias("hot_keep"), F.col("n").alias("hot_n"))
        marked = self.rows.join(F.broadcast(hot), "digest", "left")  # at most 1 / HOT_SHARE rows
        # Rows of hot groups are done; their key matches nothing and deals them evenly.
        key = F.when(F.col("hot_n").isNull(), F.col("digest")).otherwise(F.concat("digest", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        joined = marked.withColumn("key", key).join(self.hits.select(F.col("digest").alias("key"), "keep", "n"), "key", "left")
        return joined.select("doc_id", "digest", "ident", F.coalesce("hot_keep", "keep").alias("keep"), F.coalesce("hot_n", "n").alias("n"))


def _one_of_each(rows: DataFrame, names: list[str]) -> DataFrame:
    """One of the rows that share the values of `names`: first one of each task, then one of all."""
    rows = rows.withColumn("task", F.spark_partition_id())
    for group in ([*names, "task"], names):
        rows = rows.withColumn("nth", F.row_number().over(W.partitionBy(*group).orderBy("task"))).where("nth = 1")
    return rows.drop("task", "nth")


def exact_duplicates(spark: SparkSession, docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; empty texts are equal to each other. Of rows
    with equal text the one with the largest (or smallest) doc_id stays; null
    ids lose to all others. If the row that stays occurs several times with
    one doc_id, one of its occurrences is kept. Whole texts count, however
    long. An empty table gives an empty result, and other columns of `docs`
    are not read.
    """
    docs = docs.select(docs["doc_id"], docs["text"])
    found = Found(spark, docs, keep)
    found.verify(docs)
    grouped = found.scratch.keep(found.grouped(), "grouped")
    stays = F.col("n").isNotNull() & F.col("ident").eqNullSafe(F.col("keep"))
    many = grouped.where(stays).withColumn("task", F.spark_partition_id())
    nth = {}
    for name, group in (("in_task", ["digest", "task"]), ("in_all", ["digest", "in_task"])):
        nth[name] = F.row_number().over(W.partitionBy(*group).orderBy("task"))
        many = many.withColumn(name, nth[name])
    many = many.withColumn("kept", (F.col("in_task") == 1) & (F.col("in_all") == 1)).drop("task", "in_task", "in_all")
    both = grouped.where(~stays).withColumn("kept", F.col("n").isNull()).unionByName(many)
    keep_id = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(_ident(F.col("keep"), keep))
    return both.select("doc_id", keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, keep: str = "largest") -> DataFrame:
    """`docs` without the rows that `exact_duplicates` doesn't keep, all columns as they were.

    Null text counts as empty, so one of the rows without text stays. Null ids
    lose to all others; of rows that repeat one stays. Whole texts count,
    however long. An empty table gives an empty result, and columns of any
    name are carried through.
    """
    found = Found(spark, docs, keep)
    found.verify(docs)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(whole, _digest(docs["text"]).alias("digest"), _ident(docs["doc_id"], keep).alias("ident"))
    suspects, clear = split_by_key(keyed, found.hits, ["digest"])
    # Every text that may be meant has one entry, and with its identifier a key that is spread however large the group.
    entries, _ = split_by_key(found.entries.select("digest", F.col("ident").alias("keep")), found.hits, ["digest"])
    stays = suspects.join(entries.withColumnRenamed("digest", "key"), (F.col("digest") == F.col("key")) & F.col("ident").eqNullSafe(F.col("keep")))
    return clear.select("doc.*").unionAll(_one_of_each(stays, ["digest", "ident"]).select("doc.*"))
