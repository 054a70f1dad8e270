import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from hireloom.llm import huffman, media, packing, sharding
from hireloom.llm.tokens import WordEncoder, tokenizer_path

ODD = ["a\x1cb c’s don't l'été d'Été, NAÏVE... foo-bar (x) [y]", "été <|endoftext|> 12,345.6 ß ſ ŉ İ Σ", "", " \n ", "''' 's"]


def test_word_encoder_equals_the_library():
    lib, own = Tokenizer.from_file(tokenizer_path()), WordEncoder(tokenizer_path())
    own.WORDS, own.CORES = 7, 5  # turn over all the time
    for text in ODD + ["many words " * 40 + "The THE the, The. ends"] + [f"word{i} other{i}, more" for i in range(30)]:
        assert np.frombuffer(own.encode(text), own.dtype).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert own.encode(None) == b""


@pytest.fixture(scope="module")
def ids(corpus):
    lib = Tokenizer.from_file(tokenizer_path())
    return [(i, lib.encode(t or "", add_special_tokens=False).ids) for i, t, *_ in corpus]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_token_files(spark, docs, ids, empty):
    got = huffman.token_files(spark, docs).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter((i, len(x) + 1, crc([*x, 2])) for i, x in ids)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in by_start] == np.cumsum([0] + [r["n_tokens"] for r in by_start])[:-1].tolist()
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in by_start]
    assert order == sorted(order)
    assert huffman.token_files(spark, empty).count() == 0


def test_code_lengths_are_limited_and_optimal():
    counts = np.array([0, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89])
    free, short = (huffman.code_lengths(counts, bits).astype(int) for bits in (18, 4))
    merged, heap = [], counts[1:].tolist()
    while len(heap) > 1:  # plain Huffman: its cost is the sum of the merged weights
        heap.sort()
        merged.append(heap[0] + heap[1])
        heap = [*heap[2:], merged[-1]]
    assert free[0] == 0 and (counts * free).sum() == sum(merged)
    assert short.max() <= 4 and abs(sum(2.0 ** -short[counts > 0]) - 1) < 1e-12
    assert (counts * short).sum() >= (counts * free).sum()


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (255, 1), (256, 3), (10_000, 5000)])
def test_bits_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n), kinds) - 1
    lengths = huffman.code_lengths(np.bincount(ids, minlength=kinds))
    raw, marks = huffman.write_bits(ids, huffman.canonical_codes(lengths), lengths)
    assert len(marks) == -(-n // huffman.CHECKPOINT)
    assert huffman.read_bits(raw, marks, n, huffman.decode_table(lengths)).tolist() == ids.tolist()


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark, docs, ids, empty):
    got = packing.pack_documents(spark, docs, capacity=64).collect()
    want = Counter()
    for i, x in ids:
        x = [*x, 0]
        for p, s in enumerate(range(0, len(x), 64)):
            want[(i, p, s, len(x[s : s + 64]), crc(x[s : s + 64]))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = check_packing(got, 64)
    assert bins <= sum(len(x) + 1 for _, x in ids) / 64 * 1.05 + 2
    assert packing.pack_documents(spark, empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(8, 200))
    counts = {int(k): int(rng.integers(1, 30)) for k in rng.integers(1, capacity + 1, 25)}
    rows = []
    seen = Counter()
    for length, lo, hi, sequence, offset in packing.plan(counts, capacity):
        for r in range(lo, hi):
            seen[(length, r)] += 1
            rows.append({"sequence_id": sequence + r - lo, "offset": offset, "length": length})
    assert seen == Counter({(k, r): 1 for k, n in counts.items() for r in range(n)})
    bins = check_packing(rows, capacity)
    assert bins <= 1.25 * sum(k * n for k, n in counts.items()) / capacity + sum(n for k, n in counts.items() if 2 * k > capacity)


def test_media_columns(spark, docs, corpus, empty):
    got = media.media_columns(spark, docs).collect()
    want = Counter()
    for i, t, *_ in corpus:
        b = (t or "").encode()
        p = b + b"\0" * (-len(b) % 64 or (0 if b else 64))
        m = media.mux(p)
        want[(i, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), media.feature(media.describe(m)[0]))] += 1
    assert Counter(tuple(r) for r in got) == want
    assert media.media_columns(spark, empty).count() == 0


def test_media_tables_by_hand():
    """64-bit offsets and sizes, a version-1 header, 4-bit sample sizes and no keyframe table."""
    import struct

    payload = bytes(range(24))

    def file(first):
        stbl = media.box(
            b"stbl", media.full(b"stsd", 0, 0, struct.pack(">I", 1), media.box(b"mp4a", b"\0" * 28)), media.full(b"stts", 0, 0, struct.pack(">IIIII", 2, 2, 10, 1, 5)),
            media.full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, 2, 1)), media.full(b"stz2", 0, 0, struct.pack(">II", 4, 3), bytes([0x98, 0x70])),
            media.full(b"co64", 0, 0, struct.pack(">IQQ", 2, first, first + 17)),
        )
        mdhd = media.full(b"mdhd", 1, 0, struct.pack(">QQIQI", 0, 0, 1000, 25, 0))
        hdlr = media.full(b"hdlr", 0, 0, struct.pack(">I4s12s", 0, b"soun", b""), b"\0")
        moov = media.box(b"moov", media.box(b"trak", media.box(b"mdia", mdhd, hdlr, media.box(b"minf", stbl))))
        return media.box(b"ftyp", b"isom\0\0\0\0") + moov + struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload

    data = file(len(file(0)) - len(payload))
    track = media.describe(data)[0]
    assert (track["codec"], track["handler"], track["duration"], track["timescale"], track["ticks"]) == ("mp4a", "soun", 25, 1000, 25)
    assert track["sizes"].tolist() == [9, 8, 7] and track["keys"].tolist() == [0, 1, 2] and media.samples(data, track) == payload
    for broken in (b"", data[:40], data[:-30].replace(b"stsc", b"free"), b"\0\0\0\x05abcd"):
        with pytest.raises(ValueError):
            media.describe(broken)


def test_describe_media_reports_broken_files(spark):
    files = spark.createDataFrame([(1, bytearray(media.mux(b"a" * 64))), (2, bytearray(b"junk")), (3, None)], "id long, media binary")
    got = {r["id"]: (r["tracks"], r["media_error"]) for r in media.describe_media(files).collect()}
    assert got[1][0][0]["samples"] == 1 and got[1][1] is None and got[2][0] is None and got[3][1]


def test_sharding(spark, docs, corpus, empty):
    for shards in (1, 7, 24):
        got = sharding.shard_documents(spark, docs, shards).collect()
        counts = Counter(r["shard"] for r in got)
        assert len(got) == len(corpus) and max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
        for s in counts:
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(counts[s]))
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in corpus)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.shard_documents(spark, empty).count() == 0


def test_ring_segments_equal_sequential_insertion():
    import random

    rng = random.Random(3)
    points = sharding.ring(5, 8)
    loads = {arc: rng.randint(0, 9) for arc in range(len(points))}
    limits = sharding.bounds(sum(loads.values()), 5, 0.1)
    cut = sharding.segments(loads, points, limits)
    assert sum(hi - lo for _, lo, hi, _, _ in cut) == sum(loads.values())
    used = Counter()
    for _, lo, hi, shard, slot in cut:
        assert slot == used[shard]
        used[shard] += hi - lo
    assert all(used[s] <= limits[s] for s in range(5))
