"""Connected components of a graph held as an edge DataFrame."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch

EDGE = "a binary, b binary"
#: Edges that one task may hold to join them to stars.
CHUNK = 1_000_000


def _forest(whole: bool):
    """Replace a partition's edges by stars of its own components; nothing else is lost. `whole`: roots are named too."""

    def run(batches):
        parent: dict[bytes, bytes] = {}

        def root(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                ra, rb = root(a), root(b)
                if ra != rb:
                    parent[max(ra, rb)] = min(ra, rb)
        stars = [(x, r) for x in parent if (r := root(x)) != x or whole]
        yield pa.RecordBatch.from_arrays([pa.array([s[k] for s in stars], pa.binary()) for k in (0, 1)], names=["a", "b"])

    return run


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) of every node of (a, b) edges; the root is the smallest node of its component.

    Tasks first join chunks of at most `CHUNK` edges to stars. Where that leaves
    several chunks, large and small stars alternate: every round hangs nodes on the smallest
    neighbour seen, in joins and sums that are pre-aggregated by node. Rounds
    grow with the logarithm of the longest path.
    """
    own = edges.where("a != b")
    chunks = own.count() // CHUNK + 1
    stars = scratch.keep(own.coalesce(chunks).mapInArrow(_forest(chunks == 1), EDGE), "edges")
    before = None
    if chunks == 1:
        return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
    stars = stars.distinct()
    while True:
        print_ = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if print_ == before:
            break
        before = print_
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = scratch.keep(small.unionAll(down.select("a", F.col("m").alias("b"))).distinct(), "edges")
        stars = new
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return scratch.keep(stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots), "components")
