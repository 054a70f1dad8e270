"""Token-id files with canonical, length-limited Huffman codes.

Ids are counted over the whole corpus; package-merge gives code lengths of at
most `MAX_BITS`; the canonical codes follow from the lengths alone. Documents
in ascending doc_id order fill independent blocks. A block carries the bits,
the bit offset of every `CHECKPOINT`-th id, and the ids and lengths of its
documents, so any block can be read alone and its checkpoints are decoded side
by side through one lookup table.

A file is a Parquet data set of blocks beside one of the code lengths.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, running_total, tidy
from .tokens import encoder, tokenizer_path

MAX_BITS = 18
CHECKPOINT = 256
BLOCK_IDS = 65_536
BLOCK_SCHEMA = "part int, seq int, n_ids long, doc_ids binary, doc_nulls binary, doc_lens binary, bits binary, checkpoints binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `max_bits` by package-merge; 0 where a count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError("more ids than codes of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    levels = []  # per level: merged order, as True where a leaf stands
    packages = np.empty(0)
    for _ in range(max_bits):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        levels.append(by < n)
        merged = merged[by]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    bits = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        bits[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id); the high bits come first."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, last = 0, 0
    for i in order.tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For every `max_bits` bits: id << 5 | code length of the code they begin with."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.left_shift(1, max_bits - lengths[order].astype(np.int64))
    table = np.repeat(order.astype(np.int64) << 5 | lengths[order], spans)
    return np.concatenate([table, np.zeros((1 << max_bits) - len(table), dtype=np.int64)])


def write_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bits of `ids` and the bit offset of every `CHECKPOINT`-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word, shift = at >> 5, (64 - (at & 31) - size).astype(np.uint64)
    value = codes[ids] << shift
    words = int(ends[-1] >> 5) + 2 if len(ids) else 1
    # Bits of different ids don't overlap, so sums are unions; they stay below 2**32 and are exact.
    high = np.bincount(word, weights=(value >> np.uint64(32)).astype(np.float64), minlength=words)
    low = np.bincount(word + 1, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=words)
    raw = (high[:words] + low[:words]).astype(np.uint64).astype(">u4").tobytes()
    return raw[: (int(ends[-1]) + 7) // 8 if len(ids) else 0], at[::CHECKPOINT].astype("<u8")


def read_bits(raw: bytes, checkpoints: np.ndarray, n: int, table: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Ids of a block; all checkpoints step together, one id at a time."""
    if not n:
        return np.empty(0, dtype=np.int64)
    b = np.frombuffer(raw + b"\0" * 8, dtype=np.uint8).astype(np.int64)
    window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    at = checkpoints.astype(np.int64)
    last = len(window) - 1
    mask, top = (1 << max_bits) - 1, 32 - max_bits
    out = np.empty((min(n, CHECKPOINT), len(at)), dtype=np.int64)
    for step in range(len(out)):
        found = table[window[np.minimum(at >> 3, last)] >> (top - (at & 7)) & mask]
        out[step] = found >> 5
        at += found & 31
    return out.T.reshape(-1)[:n]


def _encode_ids(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        for batch in batches:
            for at, ids in enc.encode_all(batch.column(1), end):
                counts = pc.divide(pc.binary_length(ids).cast(pa.int64()), enc.dtype.itemsize)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), counts, ids], names=["doc_id", "n", "ids"])

    return run


def _unpack(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype(np.int64)


def _together(documents, least: int = BLOCK_IDS):
    """Ids of documents (n, raw), those of many in one array: counting costs as much as the vocabulary, whatever the document."""
    held, size = [], 0
    for n, raw in documents:
        held.append(_unpack(raw, n))
        size += n
        if size >= least:
            yield np.concatenate(held)
            held, size = [], 0
    if held:
        yield np.concatenate(held)


def _count_ids(batches):
    total = np.zeros(0, dtype=np.int64)
    for ids in _together(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
        own = np.bincount(ids, minlength=len(total))
        if len(own) > len(total):
            total = np.pad(total, (0, len(own) - len(total)))
        total += own
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _write_blocks(lengths: np.ndarray):
    def run(batches):
        codes = canonical_codes(lengths)
        seq, held, rows, part = 0, [], 0, None

        def block():
            ids = np.concatenate([_unpack(raw, n) for _, n, raw in held])
            bits, marks = write_bits(ids, codes, lengths)
            doc_ids = np.array([0 if d is None else d for d, _, _ in held], dtype="<i8")
            nulls = np.packbits([d is None for d, _, _ in held])
            lens = np.array([n for _, n, _ in held], dtype="<i8")
            cols = [part, seq, len(ids), doc_ids.tobytes(), nulls.tobytes(), lens.tobytes(), bits, marks.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64()] + [pa.binary()] * 5
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types)], names=NAMES)

        for batch in batches:
            for d, n, raw, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
                part = p
                held.append((d, n, raw))
                rows += n
                if rows >= BLOCK_IDS:
                    yield block()
                    seq, held, rows = seq + 1, [], 0
        if held:
            yield block()

    return run


NAMES = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]


def _read_blocks(lengths: np.ndarray):
    def run(batches):
        table = decode_table(lengths)
        for batch in batches:
            for part, seq, n, docs, nulls, lens, bits, marks in zip(*(batch.column(c).to_pylist() for c in NAMES)):
                ids = read_bits(bits, np.frombuffer(marks, "<u8"), n, table).astype("<u4")
                docs, lens = np.frombuffer(docs, "<i8"), np.frombuffer(lens, "<i8")
                null = np.unpackbits(np.frombuffer(nulls, np.uint8), count=len(docs)).astype(bool)
                starts = np.cumsum(lens) - lens
                crcs = [zlib.crc32(ids[s : s + k].tobytes()) for s, k in zip(starts.tolist(), lens.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(docs, mask=null), pa.array(np.full(len(docs), part, np.int32)), pa.array(np.full(len(docs), seq, np.int32)),
                        pa.array(starts), pa.array(lens), pa.array(crcs, pa.int64()),
                    ],
                    names=["doc_id", "part", "seq", "within", "n_tokens", "ids_crc32"],
                )

    return run


def write_token_files(
    spark: SparkSession, docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None, scratch: Scratch | None = None
) -> None:
    """Write the ids of all documents (null text: only `end_id`) under `path`: blocks/ and code/.

    Documents are in ascending doc_id order, null ids first; rows that repeat
    are written as often as they occur, rows of one doc_id in order of their
    length and ids, and an empty table gives files without blocks. A block holds
    whole documents, so a very long text is a block of its own. Other columns
    are not read.
    """
    scratch = scratch or Scratch(spark, "token-files")
    source = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    ids = scratch.keep(source.mapInArrow(tidy(_encode_ids(tokenizer or tokenizer_path(), end_id)), "doc_id long, n long, ids binary"), "ids")
    counted = ids.select("n", "ids").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = counted.toPandas()  # at most the vocabulary
    counts = np.zeros(int(found["id"].max()) + 1 if len(found) else 1, dtype=np.int64)
    counts[found["id"].to_numpy(dtype=np.int64)] = found["n"]
    lengths = code_lengths(counts)
    code = spark.createDataFrame([(lengths.tobytes(), MAX_BITS, CHECKPOINT)], "lengths binary, max_bits int, checkpoint int")
    code.coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n", "ids").withColumn("part", F.spark_partition_id())
    ordered.mapInArrow(_write_blocks(lengths), BLOCK_SCHEMA).write.mode("overwrite").parquet(f"{path}/blocks")
    scratch.drop(ids)


def read_token_files(spark: SparkSession, path: str, scratch: Scratch | None = None) -> DataFrame:
    """Decode files of `write_token_files`: doc_id, start, n_tokens, ids_crc32 per document."""
    scratch = scratch or Scratch(spark, "token-files")
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8)
    blocks = spark.read.parquet(f"{path}/blocks")
    starts = running_total(scratch, blocks.select("part", "seq", "n_ids"), ["part", "seq"], "n_ids", "base").drop("n_ids")
    docs = blocks.mapInArrow(_read_blocks(lengths), "doc_id long, part int, seq int, within long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def token_files(spark: SparkSession, docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write the files to the shared folder, read them back and return what they say of each document."""
    scratch = Scratch(spark, "token-files")
    path = scratch.path("files")
    write_token_files(spark, docs, path, end_id, tokenizer, scratch)
    return read_token_files(spark, path, scratch)
