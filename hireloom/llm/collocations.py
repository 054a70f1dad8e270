"""Phrase mining with depth-limited count tries.

Every partition is a shard: it holds the words of a bounded run of documents
and builds one trie over them, level by level (a node is its parent's number
and a word), with counts. Tries leave the shard serialised in order of their
paths; Spark deals them by prefix ranges, merges the sorted runs and adds equal
paths. Three passes build levels 1, 2 and 3 to 5; a pass only extends paths
whose parts the pass before found often enough, told by a bitmap of fixed size
(a cell that several paths share lets too much through, never too little).
Walks over the merged trie read off the counts of left parts (the ancestors)
and, over reversed paths, of right parts (the chain of suffix links).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import Scratch, small_batches, tidy

DEPTH = 5
#: Words that a shard gathers before it serialises its trie.
SHARD_WORDS = 2_000_000
#: Cells of the bitmap of frequent paths.
CELLS = 1 << 23
#: Parts of the walk that the subtrie of one first word is dealt to.
SALTS = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes as this operator reads them: A-Z lower-cased, what ends a piece as \n, tabs as spaces.
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8)] = 10
_BYTES[9] = 32

PATH = "lang string, path string, f long"
WALKED = "lang string, words array<string>, f long, parts array<long>"


def _tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of a batch of texts, the number of each one's piece and of its document."""
    texts = pc.cast(texts, pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = _BYTES[np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]] if held is not None and len(texts) else np.zeros(0, np.uint8)
    opens = offsets[:-1] - offsets[0]
    opens = opens[opens < len(data)]
    new_piece = data == 10
    keep = ~new_piece & (data != 32)
    starts = keep.copy()
    starts[1:] &= ~keep[:-1]
    starts[opens] = keep[opens]
    new_piece[opens] = True
    at = np.flatnonzero(starts)
    piece = np.cumsum(new_piece)[at]
    doc = np.searchsorted(offsets - offsets[0], at, side="right") - 1
    letters = data[keep]
    ends = np.append(np.cumsum(keep)[at] - 1, len(letters)).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(letters)), piece, doc


def path_hash(hashes: list[np.ndarray]) -> np.ndarray:
    """Cells of paths from the hashes of their words, language first."""
    total = np.zeros(len(hashes[0]), np.uint64)
    for h in hashes:
        total = (total ^ h) * _MIX
        total ^= total >> np.uint64(29)
    return (total >> np.uint64(7)) % np.uint64(CELLS)


def _hash(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def trie_levels(lang: np.ndarray, word: np.ndarray, piece: np.ndarray, n_words: int, depths: range, fits) -> list:
    """Nodes of a trie level by level: (columns of words, language, counts), in order of language and word numbers.

    `fits(i, at)` tells for each place of `at` whether the path of its first i
    words may go on; node numbers of a level come from (parent, word) pairs.
    """
    out = []
    at = np.arange(len(word))
    node = lang.astype(np.int64)
    for depth in range(1, depths.stop):
        last = at + depth - 1
        inside = last < len(word)
        at, node, last = at[inside], node[inside], last[inside]
        same = piece[last] == piece[at]
        at, node, last = at[same], node[same], last[same]
        ok = fits(depth, at)
        at, node, last = at[ok], node[ok], last[ok]
        if not len(at):
            break
        _, first, node, counts = np.unique(node * n_words + word[last], return_index=True, return_inverse=True, return_counts=True)
        if depth in depths:
            places = at[first]
            out.append((lang[places], [word[places + j] for j in range(depth)], counts))
    return out


def _shards(depths: range, bitmap, step: int):
    """Serialised tries of a partition: sorted runs of (lang, path, f), a path being words joined by spaces. `bitmap` tells which paths of `step` words are frequent."""

    def serialise(held):
        langs = pa.chunked_array([h[0] for h in held]).combine_chunks().dictionary_encode()
        words = pa.chunked_array([h[1] for h in held]).combine_chunks().dictionary_encode()
        offset, pieces = 0, []
        for h in held:
            pieces.append(h[2] + offset)
            offset += (int(h[2].max()) + 1) if len(h[2]) else 0
        piece = np.concatenate(pieces)
        lang, word = langs.indices.to_numpy().astype(np.int64), words.indices.to_numpy().astype(np.int64)
        names = words.dictionary.to_pylist()
        frequent = None
        if step:
            bits = np.frombuffer(bitmap.value, np.uint8)
            lang_hash, word_hash = _hash(langs.dictionary.to_pylist()), _hash(names)
            starts = np.arange(max(len(word) - step + 1, 0))
            starts = starts[piece[starts] == piece[starts + step - 1]]
            cell = path_hash([lang_hash[lang[starts]]] + [word_hash[word[starts + j]] for j in range(step)])
            frequent = np.zeros(len(word) + DEPTH, bool)
            frequent[starts] = (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1
            # Words on no frequent path get no number: only the others are put in order.
            on = np.zeros(len(word), bool)
            for j in range(step):
                on[j:] |= frequent[: len(word) - j]
            used = np.zeros(len(names), bool)
            used[word[on]] = True
        else:
            used = np.ones(len(names), bool)
        # Numbers in the order of the words, so that a trie in the order of its numbers is sorted.
        order = np.array(sorted(np.flatnonzero(used).tolist(), key=names.__getitem__), np.int64)
        number = np.zeros(len(names), np.int64)
        number[order] = np.arange(len(order))
        word, names = number[word], [names[i] for i in order]

        def fits(depth, at):
            if frequent is None:
                return np.ones(len(at), bool)
            if depth < step:
                return frequent[at] if step > 1 else np.ones(len(at), bool)
            return frequent[at + depth - step]

        text = pa.array(names, pa.string())
        for lang_at, columns, counts in trie_levels(lang, word, piece, max(len(names), 1), depths, fits):
            paths = pc.binary_join_element_wise(*[text.take(pa.array(c)) for c in columns], " ")
            table = pa.table({"lang": langs.dictionary.take(pa.array(lang_at)).cast(pa.string()), "path": paths, "f": pa.array(counts, pa.int64())})
            yield from table.to_batches(100_000)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            words, piece, doc = _tokens(batch.column(1))
            if not len(words):
                continue
            held.append((batch.column(0).take(pa.array(doc)), words, piece))
            size += len(words)
            if size >= SHARD_WORDS:
                yield from serialise(held)
                held, size = [], 0
        if held:
            yield from serialise(held)

    return tidy(run)


def _merge(batches):
    """Add the counts of equal neighbours of a sorted stream of paths."""
    names = ["lang", "path", "f"]
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        lang, path, f = (batch.column(i) for i in range(3))
        new = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            differs = pc.or_(pc.not_equal(path[1:], path[:-1]), pc.not_equal(lang[1:], lang[:-1]))
            new[1:] = differs.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        sums = np.add.reduceat(f.to_numpy(), starts)
        if held is not None:
            if held[:2] == (lang[0].as_py(), path[0].as_py()):
                sums[0] += held[2]
            else:
                yield pa.RecordBatch.from_arrays([pa.array([h]) for h in held], names=names)
        at = int(starts[-1])
        held = (lang[at].as_py(), path[at].as_py(), int(sums[-1]))
        places = pa.array(starts[:-1])
        yield pa.RecordBatch.from_arrays([lang.take(places), path.take(places), pa.array(sums[:-1])], names=names)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([h]) for h in held], names=names)


def merged(shards: DataFrame) -> DataFrame:
    """Tries of all shards as one: dealt by ranges of prefixes, sorted runs merged, equal paths added."""
    return shards.repartitionByRange("path", "lang").sortWithinPartitions("path", "lang").mapInArrow(_merge, PATH)


def _bitmap(spark: SparkSession, frequent: DataFrame):
    """Broadcast bits of the cells of frequent paths: `CELLS` bits whatever the data."""

    def cells(batches):
        for batch in batches:
            lang = batch.column(0).to_pylist()
            words = [p.split(" ") for p in batch.column(1).to_pylist()]
            if lang:
                columns = [_hash(lang)] + [_hash(list(c)) for c in zip(*words)]
                yield pa.RecordBatch.from_arrays([pa.array(path_hash(columns).astype(np.int32))], names=["cell"])

    bits = np.zeros(CELLS, bool)
    found = frequent.select("lang", "path").mapInArrow(cells, "cell int").distinct().toArrow()  # at most CELLS numbers
    bits[found.column("cell").to_numpy()] = True
    return spark.sparkContext.broadcast(np.packbits(bits, bitorder="little").tobytes())


def _walk(batches):
    """Counts of the ancestors of every path of two or more words, from a stream in trie order."""
    stack: list[tuple[str, int]] = []
    root = None
    for batch in batches:
        out = []
        for lang, salt, words, f in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if root != (lang, salt):
                root, stack = (lang, salt), []
            depth = 0
            while depth < min(len(stack), len(words)) and stack[depth][0] == words[depth]:
                depth += 1
            del stack[min(depth, len(words) - 1) :]
            if len(words) > 1:
                out.append((lang, words, f, [n for _, n in stack]))
            stack.append((words[-1], f))
        columns = list(zip(*out)) or [(), (), (), ()]
        types = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "words", "f", "parts"])


def walked(paths: DataFrame) -> DataFrame:
    """(lang, words, f, parts): every path of two or more words with the counts of its beginnings, shortest first.

    The subtrie of a first word is dealt by its second one, and every part gets
    the first word's own node: a word that a third of all phrases begin with is
    no single task's.
    """
    second = F.pmod(F.xxhash64(F.element_at("words", 2)), F.lit(SALTS))
    salts = F.when(F.size("words") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(second.cast("int")))
    dealt = paths.withColumn("salt", F.explode(salts)).withColumn("first", F.element_at("words", 1))
    ordered = dealt.repartition("lang", "first", "salt").sortWithinPartitions("lang", "salt", "words")
    return ordered.select("lang", "salt", "words", "f").mapInArrow(_walk, WALKED)


def _score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 * a * n / (l * r)) in decimals, exact while its products have at most 38 digits."""
    wide = lambda c: c.cast("decimal(19,0)")
    scaled = (wide(a) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)")
    return F.call_function("div", (scaled * wide(n)).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def mine_phrases(spark: SparkSession, docs: DataFrame, least: int = 100, top: int = 2_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of documents (lang, text): each language's best phrases of two to five words.

    Words, pieces, counts and scores are those of `op12`. Null texts count as
    empty, null languages as `und`; texts without words add nothing, and an
    empty table gives no rows. Very long texts are cut into words as they
    are read and count in full. Repeated rows count each time; ties go by count
    and then phrase in byte order, so no two rows share a rank. Other columns
    are ignored.
    """
    scratch = Scratch(spark, "collocations")
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))

    def level(name, depths, bitmap=None, step=0):
        with small_batches(spark, 500):
            shards = scratch.keep(texts.mapInArrow(_shards(depths, bitmap, step), PATH), f"{name}-shards")
            found = merged(shards)
            found = scratch.keep(found if depths.start == 1 else found.where(F.col("f") >= least), name)
            scratch.drop(shards)
            return found

    words = level("words", range(1, 2))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    often = words.where(F.col("f") >= least)
    ones = _bitmap(spark, often)
    pairs = level("pairs", range(2, 3), ones, 1)
    twos = _bitmap(spark, pairs)
    longer = level("longer", range(3, DEPTH + 1), twos, 2)
    paths = often.unionByName(pairs).unionByName(longer)
    trie = scratch.keep(paths.select("lang", F.split("path", " ").alias("words"), "f"), "trie")

    begins = walked(trie).withColumnRenamed("parts", "lefts")
    ends = walked(trie.withColumn("words", F.reverse("words"))).select("lang", F.reverse("words").alias("words"), F.col("parts").alias("rights"))
    both = scratch.keep(begins.join(ends, ["lang", "words"]), "walked")

    # A longer candidate around a phrase occurs at most as often; where one does equally, so does one of a single word more.
    size = F.size("words")
    whole = lambda col, part: both.where(F.element_at(col, -1) == F.col("f")).where(size > 2).select("lang", part.alias("words"))
    inside = whole("lefts", F.slice("words", 1, size - 1)).union(whole("rights", F.slice("words", 2, size - 1)))
    kept = both.join(inside.distinct(), ["lang", "words"], "left_anti").join(totals, "lang")
    cut = lambda k: F.struct(
        _score(F.col("f"), F.col("n"), F.element_at("lefts", k), F.element_at("rights", size - k)).alias("score"),
        k.alias("k"), F.element_at("lefts", k).alias("l"), F.element_at("rights", size - k).alias("r"),
    )
    lowest = F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))
    scored = kept.select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "n", lowest.alias("cut"))
    scored = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    some = scored.withColumn("salt", salt).withColumn("place", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = r"""
    WITH pieces AS (
        SELECT row_number() OVER () AS piece, lang, words FROM (
            SELECT lang, list_filter(string_split_regex(part, '[ \t]+'), lambda w: w <> '') AS words FROM (
                SELECT coalesce(lang, 'und') AS lang,
                       unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[.,;:!?\n\x0B\f\r]')) AS part
                FROM documents)
        ) WHERE len(words) > 0
    ), grams AS (
        SELECT lang, words[i:i + k - 1] AS g FROM (
            SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i
            FROM pieces, (VALUES (1), (2), (3), (4), (5)) d(k) WHERE len(words) >= k)
    ), f AS MATERIALIZED (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 100),
    n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM pieces GROUP BY lang),
    candidate AS MATERIALIZED (SELECT lang, g, a FROM f WHERE len(g) > 1),
    covered AS (
        SELECT DISTINCT p.lang, p.g FROM candidate q, range(1, 5) s(i), range(2, 5) t(k), candidate p
        WHERE k < len(q.g) AND i + k - 1 <= len(q.g) AND p.lang = q.lang AND p.g = q.g[i:i + k - 1] AND 100 * q.a >= 100 * p.a
    ), cuts AS (
        SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, n.n,
               1000::HUGEINT * c.a * n.n // (x.a::HUGEINT * y.a) AS score
        FROM candidate c JOIN n USING (lang), range(1, 5) t(k), f x, f y
        WHERE k < len(c.g) AND x.lang = c.lang AND x.g = c.g[1:k] AND y.lang = c.lang AND y.g = c.g[k + 1:len(c.g)]
    ), scored AS (
        SELECT * FROM cuts ANTI JOIN covered USING (lang, g)
        QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
    )
    SELECT lang, row_number() OVER best AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score::BIGINT AS score
    FROM scored
    WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' '))
    QUALIFY row_number() OVER best <= 2000
"""
