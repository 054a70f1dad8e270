"""N-gram Jaccard join by grouped prefixes.

A document is the set of its word shingles. Shingles are ordered by how often
they occur, rare ones first; two sets that overlap enough share a shingle
among their first n - ceil(t n) + 1. Documents with the same prefix and size
are one group, and groups that share a prefix shingle and fit in size are
candidates. Candidates are expanded to their members and verified exactly.

The frequencies are a table of fixed width: shingles that hash to one cell
are counted together. Any order gives the same result, so that only costs
precision of the order, never a link.

Large groups of near copies aren't expanded to all pairs. A first round links
the members of each list to two of their own, those that share most, and
verifies that. The next rounds take from the lists that still hold several
components, for each member, the closest members of other components, four times
as many each round, until no list has pairs left that could link two components; pairs inside one are
skipped. Before texts are moved, a pair must pass a bound: the bits in which two
parity bitmaps differ are no more than the shingles in which the sets differ.
Long sets have a second bitmap, as wide as they are long: the first would be
full of noise and let all their pairs pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, small_batches, split_by_key, tidy
from .components import connected_components

ORDER_BITS = 21
BLOCK_BITS = 14
#: A shingle that more than this many documents share (above what its cell holds by chance) is split,
#: and so is a list of more classes than this.
HOT = 20_000
BUCKET_SHINGLES = 500_000
SLICE = 1 << 20
BITMAP_BITS = 1024
#: Sets of more than `BITMAP_BITS` shingles have a second bitmap of about their size, up to this many bits.
WIDE_BITS = 1 << 17
#: Sets of `LONG` shingles or more have `EXTRA` more in their prefixes, and must share as many more.
EXTRA, LONG = 3, 8
#: Lists up to this long are done by the first round: it names all their pairs.
SHORT = 3
#: Closest members that a list names per member in the first of the later rounds.
NEAREST = 4

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64
)
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD[5])
_POWERS = [np.ones(1, dtype=np.uint64)]


def _powers(n: int) -> np.ndarray:
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        _POWERS[0] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _ODD[0]))))
    return _POWERS[0]


def _multipliers(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * _ODD[1]) | np.uint64(1)


def shingle_sets(texts: list[str | None], k: int = 5) -> list[np.ndarray]:
    """Per text its distinct k-word shingles as sorted 64-bit hashes; A-Z are lower-cased.

    A text with fewer than k words is one shingle, one without words none.
    """
    out: list[np.ndarray] = []
    raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
    lo = 0
    while lo < len(raw):
        hi, size = lo + 1, len(raw[lo])
        while hi < len(raw) and size + len(raw[hi]) < SLICE:
            size += len(raw[hi])
            hi += 1
        out += _slice_sets(raw[lo:hi], k)
        lo = hi
    return out


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, first byte and end of each word of a byte array that ends with white space."""
    space = _SPACES[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(begin):
        return np.empty(0, np.uint64), begin, end
    length = end - begin
    place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    value = _BYTES[data[~space]] * _powers(int(length.max()))[place]
    return mix(np.add.reduceat(value, np.cumsum(length) - length) + length.astype(np.uint64) * _ODD[2]), begin, end


def _slice_sets(raw: list[bytes], k: int) -> list[np.ndarray]:
    words, begin, _ = word_hashes(np.frombuffer(b"\n".join(raw).lower() + b"\n", dtype=np.uint8))
    if not len(words):
        return [np.empty(0, np.uint64)] * len(raw)
    offsets = np.cumsum([0] + [len(r) + 1 for r in raw])
    first = np.searchsorted(begin, offsets)
    m = _multipliers(k)
    n = len(words) - k + 1
    shingles = np.zeros(max(n, 0), dtype=np.uint64)
    for i in range(k):
        if n > 0:
            shingles += words[i : i + n] * m[i]
    shingles = mix(shingles)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(shingles[a : b - k + 1]))
        elif b > a:
            salted = np.append(words[a:b] * m[: b - a], np.uint64((b - a) * int(_ODD[3]) % (1 << 64)))
            out.append(mix(salted.sum(keepdims=True)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _count_cells(k: int, bits: int):
    def run(batches):
        counts = np.zeros(1 << bits, dtype=np.int64)
        for batch in batches:
            for own in shingle_sets(batch.column(0).to_pylist(), k):
                np.add.at(counts, (own >> np.uint64(64 - bits)).astype(np.int64), 1)
        blocks = counts.reshape(-1, min(len(counts), 1 << BLOCK_BITS))
        for i, block in enumerate(blocks):
            if block.any():
                small = block.astype(np.uint16 if block.max() < 1 << 16 else np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([small.tobytes()], pa.binary())], names=["block", "counts"])

    return run


def _sum_cells(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(width, dtype=np.int64), None
        for batch in batches:
            block = batch.column(0).slice(0, 1)
            for raw in batch.column(1):
                raw = raw.as_py()
                total += np.frombuffer(raw, np.uint16 if len(raw) == 2 * width else np.int64)
        most = np.iinfo(np.uint32).max
        yield pa.RecordBatch.from_arrays([block, pa.array([np.minimum(total, most).astype(np.uint32).tobytes()], pa.binary())], names=["block", "counts"])

    return run


def shingle_frequencies(docs: DataFrame, k: int, bits: int) -> np.ndarray:
    """Documents per cell of the shingle space, over all documents: 2**bits numbers."""
    width = min(1 << bits, 1 << BLOCK_BITS)
    parts = docs.select("text").mapInArrow(tidy(_count_cells(k, bits)), "block int, counts binary")
    out = np.zeros(1 << bits, dtype=np.uint32)
    for r in parts.groupBy("block").applyInArrow(_sum_cells(width), "block int, counts binary").toLocalIterator():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return out


def parity(own: np.ndarray, bits: int = BITMAP_BITS) -> bytes:
    """Bitmap in which every shingle flips one bit; `bits` is a power of two."""
    odd = np.bincount((mix(own) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_parity(own: np.ndarray) -> bytes | None:
    return parity(own, min(WIDE_BITS, 1 << (len(own) - 1).bit_length())) if len(own) > BITMAP_BITS else None


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded to the other's width."""
    x, y = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    return int(np.bitwise_count(np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0) ^ x).sum(dtype=np.int64))


def may_link(n_a, n_b, differing, percent: int):
    """Whether sets of these sizes that differ in at least so many elements can be similar enough."""
    return (100 + percent) * differing <= (100 - percent) * (n_a + n_b)


def prefix_size(n: int, percent: int) -> int:
    """The first shingles of two sets of which the similar share one; `EXTRA` more of each, and they share so many more."""
    return min(n, n - (percent * n + 99) // 100 + 1 + (EXTRA if n >= LONG else 0)) if n else 0


def _describe(k: int, percent: int, cells):
    def run(batches):
        counts = cells.value
        shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), k)
            classes, groups, prefixes, bitmaps, wide = [], [], [], [], []
            for own in sets:
                order = np.lexsort((own, counts[(own >> shift).astype(np.int64)]))
                prefix = own[order[: prefix_size(len(own), percent)]].tobytes()
                classes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                groups.append(int.from_bytes(hashlib.blake2b(prefix, digest_size=8, salt=len(own).to_bytes(8, "little")).digest(), "little", signed=True))
                prefixes.append(prefix)
                bitmaps.append(parity(own))
                wide.append(wide_parity(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.binary()),
                 pa.array(groups, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(bitmaps, pa.binary()), pa.array(wide, pa.binary())],
                names=["doc_id", "row_key", "n", "cls", "grp", "prefix", "bitmap", "wide"],
            )

    return run


def _runs(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the runs of equal values."""
    cuts = np.concatenate(([0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1, [len(sorted_)])).tolist()
    return list(zip(cuts[:-1], cuts[1:])) if len(sorted_) else []


def _scatter(buckets: int, cells, noise: float):
    """Deal prefix shingles out to buckets, packed; hot shingles are dealt to several by group."""

    def run(batches):
        counts = cells.value
        shift = np.uint64(64 - int(len(counts)).bit_length() + 1)
        seen: set[int] = set()
        held: list[tuple] = []
        rows = 0

        def out():
            tok = np.concatenate([t for t, _, _ in held])
            size = np.array([len(t) for t, _, _ in held])
            doc = np.repeat(np.arange(len(held)), size)
            grp, n = np.array([g for _, g, _ in held], np.int64), np.array([n for _, _, n in held], np.int32)
            parts = np.maximum(1, np.ceil((counts[(tok >> shift).astype(np.int64)] - noise) / HOT)).astype(np.uint64)
            salt = np.where(parts > 1, mix(grp.view(np.uint64))[doc] % parts, 0).astype(np.int64)
            bucket = (((mix(tok) >> np.uint64(1)) % np.uint64(buckets)).astype(np.int64) + salt) % buckets
            mark = np.where(parts > 1, salt, -1).astype(np.int16 if parts.max() < 1 << 15 else np.int32)
            order = np.argsort(bucket, kind="stable")
            tok, doc, mark, bucket = tok[order], doc[order], mark[order], bucket[order]
            rows = []
            for lo, hi in _runs(bucket):
                # A document's shingles stand together; it is named once.
                first = np.flatnonzero(np.diff(doc[lo:hi], prepend=-1))
                own = doc[lo:hi][first]
                count = np.diff(np.append(first, hi - lo)).astype(np.int32)
                marks = mark[lo:hi].astype(np.int32).tobytes() if (mark[lo:hi] >= 0).any() else b""
                rows.append((int(bucket[lo]), tok[lo:hi].tobytes(), grp[own].tobytes(), n[own].tobytes(), count.tobytes(), marks))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["bucket", "tok", "grp", "n", "count", "salt"]
            )

        for batch in batches:
            for n, g, prefix in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if g in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(g)
                tok = np.frombuffer(prefix, np.uint64)
                held.append((tok, g, n))
                rows += len(tok)
            if rows >= 1_000_000:
                yield from out()
                held, rows = [], 0
        if rows:
            yield from out()

    return run


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct row of equally long columns, and how often it occurs."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[order[1:]] != c[order[:-1]]
    at = np.flatnonzero(new)
    return order[at], np.diff(np.append(at, len(order)))


LIST_SCHEMA = "l1 long, l2 long, salt int, weight int, need int, grps binary, ns binary"
#: Marks rows of `_lists` that are pairs (l1, l2) and not lists.
PAIR = -2


def _lists(percent: int):
    return lambda table: _bucket_lists(table, percent)


def _bucket_lists(table: pa.Table, percent: int) -> pa.Table:
    """Lists of the groups that share a prefix shingle; short ones as their pairs, equal ones once.

    A split shingle gives a list per part, under its own name, even of one group.
    """
    columns = [[], [], [], []]
    for tok, grp, n, count, salt in zip(*(table.column(c).to_pylist() for c in ("tok", "grp", "n", "count", "salt"))):
        count = np.frombuffer(count, np.int32)
        columns[0].append(np.frombuffer(tok, np.uint64))
        columns[1].append(np.repeat(np.frombuffer(grp, np.int64), count))
        columns[2].append(np.repeat(np.frombuffer(n, np.int32), count))
        columns[3].append(np.frombuffer(salt, np.int32) if salt else np.full(count.sum(), -1, np.int32))
    tok, grp, n, salt = (np.concatenate(c) for c in columns)
    order = np.lexsort((grp, n, salt, tok))
    tok, grp, n, salt = tok[order], grp[order], n[order], salt[order]
    new = np.concatenate(([True], (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1]) | (n[1:] != n[:-1]) | (grp[1:] != grp[:-1])))
    tok, grp, n, salt = tok[new], grp[new], n[new], salt[new]
    start = np.flatnonzero(np.concatenate(([True], (tok[1:] != tok[:-1]) | (salt[1:] != salt[:-1]))))
    size = np.diff(np.append(start, len(tok)))
    hashed = mix(grp.view(np.uint64))
    sums = np.add.reduceat(hashed, start), np.add.reduceat(mix(hashed ^ _ODD[4]), start)
    split = salt[start] >= 0
    l1 = np.where(split, tok[start].view(np.int64), sums[0].view(np.int64))
    l2 = np.where(split, -1, sums[1].view(np.int64) & np.int64(0x7FFFFFFFFFFFFFFF))
    # Pairs of short lists, with the shingles that they share here.
    left, right = [], []
    for m in range(2, SHORT + 1):
        first = start[(size == m) & ~split]
        for i in range(m):
            for j in range(i):
                left.append(first + j)
                right.append(first + i)
    left, right = np.concatenate(left), np.concatenate(right)
    fits = (n[left].astype(np.int64) * 100 >= n[right].astype(np.int64) * percent) & (n[right].astype(np.int64) * 100 >= n[left].astype(np.int64) * percent)
    left, right = left[fits], right[fits]
    low, high = np.minimum(grp[left], grp[right]), np.maximum(grp[left], grp[right])
    need = np.where((n[left] >= LONG) & (n[right] >= LONG), 1 + EXTRA, 1).astype(np.int32)
    one, shared = _distinct(low, high)
    low, high, need = low[one], high[one], need[one]
    # Longer lists, each once, with the shingles that have it.
    keep = np.flatnonzero((size > SHORT) | split)
    first, same = _distinct(l1[keep], l2[keep], salt[start][keep])
    keep = keep[first]
    # In a list first come the groups that share most with others here.
    names, place = np.unique(grp, return_inverse=True)
    shares = np.bincount(place, weights=np.repeat(size, size), minlength=len(names))[place]
    order = np.lexsort((grp, n, -shares, np.repeat(np.arange(len(size)), size)))
    grp, n = grp[order], n[order]
    spans = [(int(start[i]), int(start[i] + size[i])) for i in keep]
    none = [None] * len(low)
    cat = lambda a, b: pa.array(np.concatenate([a, b]))
    return pa.table(
        {
            "l1": cat(low, l1[keep]), "l2": cat(high, l2[keep]),
            "salt": cat(np.full(len(low), PAIR, np.int32), salt[start][keep]),
            "weight": cat(shared.astype(np.int32), same.astype(np.int32)), "need": cat(need, np.ones(len(keep), np.int32)),
            "grps": pa.array(none + [grp[a:b].tobytes() for a, b in spans], pa.binary()),
            "ns": pa.array(none + [n[a:b].tobytes() for a, b in spans], pa.binary()),
        }
    )


def _star_pairs(percent: int):
    """Each group of a list with the first two others that fit in size."""

    def run(batches):
        for batch in batches:
            left, right = [], []
            for grps, ns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, n = np.frombuffer(grps, np.int64), np.frombuffer(ns, np.int32).astype(np.int64)
                named = np.zeros(len(g), np.int64)
                # Nearly always the first few have partners for all; the rest is left to the later rounds.
                for centre in range(min(8, len(g) - 1)):
                    open_ = np.flatnonzero(named[centre + 1 :] < 2) + centre + 1
                    fits = open_[(n[open_] * 100 >= n[centre] * percent) & (n[centre] * 100 >= n[open_] * percent)]
                    named[fits] += 1
                    left.append(np.full(len(fits), g[centre]))
                    right.append(g[fits])
            if left:
                a, b = np.concatenate(left), np.concatenate(right)
                pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["ga", "gb"])

    return run


MEMBER = np.dtype([("cls", "V16"), ("root", "<u8", 2), ("bits", "<u8", BITMAP_BITS // 64)])


class Members:
    """A list's members by size: class, root, bitmap."""

    def __init__(self, n: np.ndarray, raw: np.ndarray):
        self.n, self.cls, self.root, self.bits = n, raw["cls"], raw["root"], raw["bits"]


def _members(column: pa.Array) -> list[Members]:
    structs = column.flatten()
    n = structs.field("n").to_numpy(zero_copy_only=False)
    raw = np.frombuffer(b"".join(structs.field("m").to_pylist()), MEMBER)
    ends = np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    return [Members(n[a:b], raw[a:b]) for a, b in zip(np.append(0, ends[:-1]).astype(int), ends.astype(int))] if len(column) else []


def _closest(percent: int, most: int):
    """Per member the `most` closest members of other components that could link; if there were more, with the list's name."""

    def pairs(x: Members, y: Members, name: tuple, out: list) -> None:
        for lo in range(0, len(x.n), 128):
            part = slice(lo, lo + 128)
            # Members are sorted by size: only a stretch of y fits.
            a = np.searchsorted(y.n, -(-x.n[part].min() * percent // 100))
            b = np.searchsorted(y.n, x.n[part].max() * 100 // percent, side="right")
            apart = (x.root[part][:, None] != y.root[a:b][None]).any(axis=2)
            rows = np.flatnonzero(apart.any(axis=1))
            if not len(rows):
                continue
            differ = np.bitwise_count(x.bits[part][rows][:, None] ^ y.bits[a:b][None]).sum(axis=2, dtype=np.int64)
            n_a, n_b = x.n[part][rows][:, None], y.n[a:b][None]
            fits = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
            ok = apart[rows] & fits & may_link(n_a, n_b, differ, percent)
            rank = np.where(ok, differ * 1000 // (n_a + n_b), 1 << 40)
            for i in np.flatnonzero(ok.any(axis=1)):
                found = np.flatnonzero(ok[i])
                cut = len(found) > most
                if cut:
                    found = found[np.argpartition(rank[i][found], most)[:most]]
                me = x.cls[lo + rows[i]].tobytes()
                for j in found:
                    them = y.cls[a + j].tobytes()
                    out.append((min(me, them), max(me, them), *(name if cut else (None, None))))

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            names = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            for x, y, name in zip(_members(batch.column(0)), _members(batch.column(1)), names):
                if len(y.n):
                    pairs(x, y, name, out)
                    pairs(y, x, name, out)
                else:
                    pairs(x, x, name, out)
            out = list(dict.fromkeys(out))
            kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=["a", "b", "l1", "l2"])

    return run


def _entries(batches):
    for batch in batches:
        l1, l2, salt = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2))
        grps = [np.frombuffer(g, np.int64) for g in batch.column(3).to_pylist()]
        size = [len(g) for g in grps]
        if grps:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(x, size)) for x in (l1, l2, salt)] + [pa.array(np.concatenate(grps))], names=["l1", "l2", "salt", "grp"]
            )


def _bounded(percent: int):
    """Pairs that fit in size and whose bitmaps don't rule them out, and how far those are apart (per mille)."""

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            bits = [np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u8").reshape(len(n_a), -1) for i in (4, 5)] if len(n_a) else [np.zeros((0, 1), "<u8")] * 2
            differ = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            fits = (n_a * 100 >= n_b * percent) & (n_b * 100 >= n_a * percent)
            at = pa.array(np.flatnonzero(fits & may_link(n_a, n_b, differ, percent)))
            apart = pa.array((differ * 1000 // np.maximum(n_a + n_b, 1)).astype(np.int64)).take(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), apart], names=["a", "b", "apart"])

    return run


def _bounded_long(percent: int):
    """Pairs without those of long sets that their wide bitmaps rule out; `apart` by these where there are two."""

    def run(batches):
        for batch in batches:
            at, apart = [], []
            columns = (batch.column(i).to_pylist() for i in range(2, 7))
            for i, (far, n_a, n_b, a, b) in enumerate(zip(*columns)):
                if a is not None and b is not None:
                    differ = differing(a, b)
                    if not may_link(n_a, n_b, differ, percent):
                        continue
                    far = differ * 1000 // (n_a + n_b)
                at.append(i)
                apart.append(far)
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(apart, pa.int64())], names=["a", "b", "apart"])

    return run


def without_far(classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, apart) pairs that the wide bitmaps of long sets leave."""
    long_ = classes.where("wide is not null")
    one = lambda c: long_.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("wide").alias(f"w{c}"))
    both = pairs.join(one("a"), "a", "left").join(one("b"), "b", "left").select("a", "b", "apart", "na", "nb", "wa", "wb")
    return both.mapInArrow(_bounded_long(percent), "a binary, b binary, apart long")


def _verify(k: int, percent: int):
    def run(batches):
        for batch in batches:
            at = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                a, b = part.column(2).to_pylist(), part.column(3).to_pylist()
                names = dict(zip(part.column(0).to_pylist(), a)) | dict(zip(part.column(1).to_pylist(), b))
                sets = dict(zip(names, shingle_sets(list(names.values()), k)))
                for i, (x, y) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                        at.append(lo + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64()))], names=["a", "b"])

    return run


def row_names() -> tuple:
    """What tells rows apart: the id (null as the largest) and a hash of id and text."""
    return F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("row_id"), F.xxhash64("doc_id", "text").alias("row_key")


def verify_pairs(scratch: Scratch, docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The (a, b) of class pairs whose sets are similar enough, by their texts."""
    need = pairs.select(F.col("a").alias("cls")).unionAll(pairs.select(F.col("b").alias("cls"))).distinct()
    keys = need.join(classes, "cls").select("cls", "row_id", "row_key")
    maybe, _ = split_by_key(docs.select("text", *row_names()), keys, ["row_key"])
    # Rows that repeat have one name and one text; the join has dealt them by it already.
    named = maybe.join(keys, ["row_id", "row_key"]).groupBy("row_id", "row_key", "cls").agg(F.min("text").alias("text"))
    texts = scratch.keep(named.select("cls", "text"), "texts")
    left = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
    links = scratch.keep(both.select("a", "b", "ta", "tb").mapInArrow(tidy(_verify(k, percent)), "a binary, b binary"), "links")
    scratch.drop(texts)
    return links


def _pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a != b").distinct()


def near_duplicates(
    spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 75, order_bits: int = ORDER_BITS
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id.

    Words are runs of anything but ASCII white space, A-Z lower-cased, of the
    whole text. A text of fewer than `k` words is one shingle. Two documents
    link when 100 * intersection >= percent * union of their sets; a
    component's id is its smallest doc_id, null ids aside. Documents without
    words (or with null text) link with nothing and are their own component.
    Rows that repeat have equal sets and so one component. An empty table
    gives an empty result; other columns are not read.
    """
    found = near_components(spark, docs, k, percent, order_bits)
    return found.select("doc_id", "n_shingles", "component_id")


def near_components(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 75, order_bits: int = ORDER_BITS) -> DataFrame:
    """`near_duplicates` with more columns: row_id and row_key name the row, root (binary) its component; null without words."""
    with small_batches(spark):
        return _near_duplicates(spark, docs, k, percent, order_bits)


def _near_duplicates(spark: SparkSession, docs: DataFrame, k: int, percent: int, order_bits: int) -> DataFrame:
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    counts = shingle_frequencies(docs, k, order_bits)
    mean = counts.mean(dtype=np.float64)
    noise = mean + 6 * mean**0.5
    cells = spark.sparkContext.broadcast(counts)  # 4 bytes x 2**order_bits, whatever the data
    del counts
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    info = scratch.keep(
        rows.mapInArrow(tidy(_describe(k, percent, cells)), "doc_id long, row_key long, n long, cls binary, grp long, prefix binary, bitmap binary, wide binary"), "sets"
    )
    some = info.where("n > 0")
    first = F.min(F.struct(row_names()[0], "row_key")).alias("first")
    classes = some.groupBy("cls").agg(
        first, F.min("n").alias("n"), F.min("grp").alias("grp"), F.min("doc_id").alias("doc_id"), F.min("bitmap").alias("bitmap"), F.min("wide").alias("wide")
    )
    classes = scratch.keep(classes.select("cls", "n", "grp", "doc_id", "bitmap", "wide", "first.row_id", "first.row_key"), "classes")

    total = some.agg(F.sum(F.octet_length("prefix")) / 8).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, int(total // BUCKET_SHINGLES) + 1)
    packed = some.select(F.col("n").cast("int"), "grp", "prefix").mapInArrow(
        tidy(_scatter(buckets, cells, noise)), "bucket int, tok binary, grp binary, n binary, count binary, salt binary"
    )
    found = scratch.keep(packed.groupBy("bucket").applyInArrow(_lists(percent), LIST_SCHEMA), "found")
    cells.destroy()
    lists = found.where(F.col("salt") != PAIR).groupBy("l1", "l2", "salt").agg(F.first("grps").alias("grps"), F.first("ns").alias("ns"))
    lists = scratch.keep(lists, "lists")
    # A pair of short lists that shares too little is done: if it shares more in longer lists, the later rounds meet it there.
    enough = found.where(F.col("salt") == PAIR).groupBy(F.col("l1").alias("ga"), F.col("l2").alias("gb")).agg(F.sum("weight").alias("w"), F.max("need").alias("need"))
    enough = scratch.keep(enough.where("w >= need").select("ga", "gb"), "enough")
    scratch.drop(found)
    # The parts of a split shingle are tied together by the first group of each.
    heads = (
        lists.where("l2 = -1").select("l1", "l2", "salt", "grps", "ns").mapInArrow(_heads, "l1 long, grp long, n int").groupBy("l1").applyInArrow(_head_list, "grps binary, ns binary")
    )
    stars = lists.select("grps", "ns").unionAll(heads).mapInArrow(_star_pairs(percent), "ga long, gb long").unionAll(enough).distinct()

    # A group stands for its smallest class; further classes of a group are tied to that one.
    chosen = classes.groupBy("grp").agg(F.min(F.struct("cls", "n", "bitmap")).alias("c"), F.count("*").alias("classes"))
    chosen = scratch.keep(chosen.select("grp", "c.cls", "c.n", "c.bitmap", "classes"), "groups")
    one = lambda g, c: chosen.select(F.col("grp").alias(g), F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"m{c}"))
    expanded = stars.join(one("ga", "a"), "ga").join(one("gb", "b"), "gb").select("a", "b", "na", "nb", "ma", "mb")
    several = chosen.where("classes > 1")
    own = classes.select("grp", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
    members = own.join(several.select("grp", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma")), "grp")
    members = members.where("a != b").select("a", "b", "na", "nb", "ma", "mb")
    passed = expanded.unionAll(members).mapInArrow(_bounded(percent), "a binary, b binary, apart long")
    passed = passed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").where("a != b").distinct()
    passed = scratch.keep(without_far(classes, passed, percent), "pairs")
    # Most pairs of a group of near copies need no look at the texts: first each class tries its closest partner.
    ends = passed.select(F.col("a").alias("cls"), "a", "b", "apart").unionAll(passed.select(F.col("b").alias("cls"), "a", "b", "apart"))
    closest = ends.groupBy("cls").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
    tried = [scratch.keep(closest, "tried")]
    links = [verify_pairs(scratch, docs, classes, tried[0], k, percent)]
    roots = connected_components(scratch, links[0])
    named = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    open_ = passed.select("a", "b").join(tried[0], ["a", "b"], "left_anti").join(named("a"), "a", "left").join(named("b"), "b", "left")
    open_ = scratch.keep(open_.where("root_a is null or root_b is null or root_a != root_b").select("a", "b"), "tried")
    scratch.drop(passed)
    if not open_.isEmpty():
        tried.append(open_)
        links.append(verify_pairs(scratch, docs, classes, open_, k, percent))
        roots = connected_components(scratch, scratch.together(links))

    shared = lists.select("l1", "l2", "salt", "grps").mapInArrow(_entries, "l1 long, l2 long, salt int, grp long").select("l1", "l2", "grp")
    inside = several.select(F.col("grp").alias("l1"), F.lit(-2).cast("long").alias("l2"), "grp")
    # So do pairs of short lists in which a group has several classes: the first round tried one of each.
    wide = enough.join(several, F.col("ga") == F.col("grp"), "left_semi").unionAll(enough.join(several, F.col("gb") == F.col("grp"), "left_semi"))
    wide = wide.distinct().select(F.xxhash64("ga", "gb").alias("l1"), F.lit(-3).cast("long").alias("l2"), F.explode(F.array("ga", "gb")).alias("grp"))
    tied = scratch.keep(inside.unionAll(wide), "tied")
    entries, former = shared.unionAll(tied), [lists, enough, tied]
    most = NEAREST
    while True:
        placed = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select(
            "cls", "grp", "n", "bitmap", F.coalesce("root", "cls").alias("root")
        )
        placed = scratch.keep(placed, "placed")
        here = entries.join(placed.groupBy("grp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("classes")), "grp")
        mixed = here.groupBy("l1", "l2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("classes").alias("size")).where("lo != hi")
        # Lists of one component stay so; they are left out from here on.
        apart = scratch.keep(entries.join(mixed.select("l1", "l2", "size"), ["l1", "l2"]).select("l1", "l2", "size", "grp"), "apart")
        scratch.drop(*former)
        former = [apart, placed]
        # A long list is dealt to parts of about `HOT` classes, which are crossed part by part.
        parts = F.ceil(F.col("size") / F.lit(HOT))
        full = apart.join(placed, "grp").withColumn("part", F.when(parts > 1, F.pmod(F.xxhash64("cls"), parts)).otherwise(0))
        member = F.struct("n", F.concat("cls", "root", "bitmap").alias("m"))
        gathered = full.groupBy("l1", "l2", "part").agg(F.sort_array(F.collect_list(member)).alias("members"))  # by size
        pairs = gathered.select("members", F.array().cast("array<struct<n:bigint,m:binary>>").alias("other"), "l1", "l2")
        if not apart.where(F.col("size") > F.lit(HOT)).isEmpty():
            long_ = full.where(F.col("size") > F.lit(HOT)).groupBy("l1", "l2", "part").agg(F.sort_array(F.collect_list(member)).alias("members"))
            x, y = long_.alias("x"), long_.alias("y")
            crossed = x.join(y, (F.col("x.l1") == F.col("y.l1")) & (F.col("x.l2") == F.col("y.l2")) & (F.col("x.part") < F.col("y.part")))
            pairs = pairs.unionAll(crossed.select("x.members", F.col("y.members").alias("other"), "x.l1", "x.l2"))
        found = scratch.keep(pairs.mapInArrow(tidy(_closest(percent, most)), "a binary, b binary, l1 long, l2 long"), "closest")
        new = found.select("a", "b").distinct().join(scratch.together(tried), ["a", "b"], "left_anti").withColumn("apart", F.lit(0).cast("long"))
        new = scratch.keep(without_far(classes, new, percent).select("a", "b"), "tried")
        if not new.isEmpty():
            tried.append(new)
            links.append(verify_pairs(scratch, docs, classes, new, k, percent))
            roots = connected_components(scratch, scratch.together(links))
        # A list that named all its pairs is done; only those that had more go on.
        more = scratch.keep(found.where("l1 is not null").select("l1", "l2").distinct(), "more")
        scratch.drop(found)
        if more.isEmpty():
            break
        entries = apart.select("l1", "l2", "grp").join(more, ["l1", "l2"], "left_semi")
        former.append(more)
        most *= 4
    scratch.drop(*former)

    by_class = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    smallest = by_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_class = scratch.keep(by_class.select("cls", "root").join(smallest, "root").select("cls", "root", "component_id"), "named")
    out = info.select("doc_id", "row_key", "n", "cls").join(by_class, "cls", "left")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        row_names()[0], "row_key", F.when(F.col("n") > 0, F.col("root")).alias("root"),
    )


def _heads(batches):
    for batch in batches:
        l1, grps, ns = (batch.column(i) for i in (0, 3, 4))
        yield pa.RecordBatch.from_arrays(
            [
                l1,
                pa.array([int(np.frombuffer(g[:8], np.int64)[0]) for g in grps.to_pylist()], pa.int64()),
                pa.array([int(np.frombuffer(n[:4], np.int32)[0]) for n in ns.to_pylist()], pa.int32()),
            ],
            names=["l1", "grp", "n"],
        )


def _head_list(table: pa.Table) -> pa.Table:
    grp, n = table.column("grp").to_numpy(), table.column("n").to_numpy()
    order = np.lexsort((grp, n))
    return pa.table(
        {"grps": pa.array([grp[order].astype(np.int64).tobytes()], pa.binary()), "ns": pa.array([n[order].astype(np.int32).tobytes()], pa.binary())}
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """`docs` with one row of each component, the one with the smallest id; all columns as they were.

    Null ids come last, and of rows with one id and different texts any may
    stay. Rows that repeat are one component, so one of them stays. Rows
    without words (null and empty texts too) link with nothing and all stay.
    Whole texts count, however long. An empty table gives an empty result, and
    columns of any name are carried through.
    """
    from pyspark.sql import Window as W

    scratch = Scratch(spark, "near-dedup")
    found = scratch.keep(near_components(spark, docs, k, percent).where("root is not null").select("row_id", "row_key", "root"), "found")
    stays = found.groupBy("root").agg(F.min(F.struct("row_id", "row_key")).alias("s")).select("s.row_id", "s.row_key")
    # Most rows have a component of their own: they are named once and stay where they are.
    several = found.groupBy("root").count().where("count > 1").select("root")
    marked = found.join(several, "root", "left_semi").select("row_id", "row_key").distinct().join(stays.withColumn("stays", F.lit(True)), ["row_id", "row_key"], "left")
    marked = scratch.keep(marked, "marked")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = docs.select(whole, F.coalesce(docs["doc_id"].cast("long"), F.lit((1 << 63) - 1)).alias("row_id"), F.xxhash64(docs["doc_id"].cast("long"), docs["text"]).alias("row_key"))
    suspects, clear = split_by_key(keyed, marked, ["row_id", "row_key"])
    joined = suspects.join(marked.withColumn("seen", F.lit(True)), ["row_id", "row_key"], "left")
    single = joined.where("seen is null")
    # Rows that repeat share a name: one of each task, then one of all.
    again = joined.where("stays").withColumn("task", F.spark_partition_id())
    for names in (["row_id", "row_key", "task"], ["row_id", "row_key"]):
        again = again.withColumn("nth", F.row_number().over(W.partitionBy(*names).orderBy("task"))).where("nth = 1")
    return clear.select("doc.*").unionAll(single.select("doc.*")).unionAll(again.select("doc.*"))
