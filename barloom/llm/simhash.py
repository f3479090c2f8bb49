"""SimHash near-duplicates: fingerprints, multi-index hashing over their halves, and components of the links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEED = 42
HOT_BUCKET = 8192


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of ``words`` words, repeats included; a shorter text is one shingle, a blank one has none."""
    parts = text.lower().split()  # bytes: lower-cases A-Z only and splits at the six ASCII blanks
    if not parts:
        return np.zeros(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        end = np.cumsum(length + 1) - 1
        first = (end - length)[: len(parts) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(first, end[words - 1 :].tolist(), strict=True)]
    return np.array(hashes, np.uint64)


def majority(h: np.ndarray) -> int:
    """The SimHash of shingle hashes, as a signed integer: the bits that are set in over half of them."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 65_536):  # a very long text is unpacked piece by piece
        block = h[at : at + 65_536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * votes > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, words: int) -> int:
    """The 64-bit SimHash of a text, as a signed integer, over its shingles of ``words`` words, repeats included."""
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """One row per row of ``docs``: its id and ``fp``, a long.

    Null texts have the fingerprint of empty ones, zero; very long texts are hashed whole. Null and repeated ids each
    give their row; an empty table gives an empty result; extra columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t or b"", words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["id", "fp"])

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(each, f"id {id_type}, fp long")


def _half(fp: Column, which: int) -> Column:
    return (F.shiftright(fp, 32) if which else fp).bitwiseAND(0xFFFFFFFF)


def _masks(most: int) -> Column:
    """All 32-bit masks that blank exactly ``most`` bits (fewer differing bits fit under some of them)."""
    return F.array(*[F.lit(0xFFFFFFFF - sum(1 << b for b in bits)) for bits in combinations(range(32), most)])


def near_pairs(nodes: DataFrame, distance: int = 3, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Links ``a``, ``b`` between the distinct fingerprints ``nodes`` (fp long) at up to ``distance`` bits.

    Two fingerprints within 3 bits have a 32-bit half that differs in at most one bit. So every fingerprint stands
    in two tables under its halves, and looks up, for each half, the ball of radius one around it; full distances
    verify the matches. A half that differs in one bit has that bit set on exactly one side, so looking up the half
    itself and the half with each set bit cleared finds every pair, from one side only.

    A table bucket of over ``hot_bucket`` fingerprints would give pairs in number of its square. Such buckets link
    through centres instead: two members that agree in the other half outside some 3 blanked bits (2 for those who
    came by a cleared bit) are surely near, so the smallest owner under each blanked key takes all others. All near
    members share such a key, so every link's two ends stay connected; rows grow with the bucket, not its square.
    """
    if not 0 <= distance <= 3:
        raise ValueError("halves with balls of radius one find distances up to 3")
    spark = nodes.sparkSession
    halves = [
        nodes.select(F.lit(i).alias("seg"), _half(F.col("fp"), i).alias("key"), "fp", _half(F.col("fp"), 1 - i).alias("other"))
        for i in (0, 1)
    ]
    owners = materialise(halves[0].unionByName(halves[1]))
    bits = F.array(*[F.lit(1 << b) for b in range(32)])
    cleared = F.transform(
        F.filter(bits, lambda b: F.col("key").bitwiseAND(b) != 0), lambda b: F.col("key").bitwiseXOR(b)
    )
    probes = owners.select("seg", F.explode(cleared).alias("key"), "fp", "other")

    def verified(left: DataFrame, right: DataFrame, same: bool) -> DataFrame:
        l = left.select("seg", "key", F.col("fp").alias("a"))  # noqa: E741
        r = right.select("seg", "key", F.col("fp").alias("b"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
        if same:
            near = near & (F.col("a") < F.col("b"))
        return l.join(r, ["seg", "key"]).where(near).select("a", "b")

    hot = owners.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket)
    hot = materialise(hot.select("seg", "key"))
    if hot.isEmpty():
        found = verified(owners, owners, True).unionByName(verified(owners, probes, False))
        return found.distinct()
    cold = owners.join(hot, ["seg", "key"], "left_anti")
    hot_own = owners.join(hot, ["seg", "key"])
    hot_probe = probes.join(hot, ["seg", "key"])
    found = verified(cold, cold, True).unionByName(verified(cold, probes, False))
    for radius, comers in ((distance, hot_own), (distance - 1, hot_probe)):
        if radius < 0:
            continue
        mask = F.explode(_masks(radius)).alias("mask")
        blank = F.col("other").bitwiseAND(F.col("mask")).alias("rest")
        centre = hot_own.select("seg", "key", "other", "fp", mask).groupBy("seg", "key", "mask", blank).agg(F.min("fp").alias("a"))
        mine = comers.select("seg", "key", "other", F.col("fp").alias("b"), mask).withColumn("rest", blank)
        found = found.unionByName(
            centre.join(mine, ["seg", "key", "mask", "rest"]).where("a <> b").select("a", "b")
        )
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node that the undirected links ``a``, ``b`` (longs) reach from it.

    Alternates the two star operations on edge tables: link every larger neighbour to the smallest one, then every
    smaller neighbour to the smallest one, until no edge changes. Each is one aggregation and one join; a node with
    a great many neighbours is a hot join key only, which adaptive execution splits.
    """

    def smallest(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))

    def mark(pairs: DataFrame) -> tuple:
        return tuple(
            pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        )

    now = materialise(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    )
    seen = mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialise(
            both.join(smallest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        low = smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        now = materialise(small.where("u > v").distinct())
        before, seen = seen, mark(now)
        if seen == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionByName(now.select(F.col("u").alias("node"), F.col("v").alias("root")))


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    distance: int = 3,
    hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """One row per row of ``docs``: id, ``fingerprint`` in 16 hex digits, ``component_id`` and ``component_size``.

    Documents link when their fingerprints differ in up to ``distance`` bits; ``component_id`` is the smallest id
    that links reach. Documents of one fingerprint are one node, named by their smallest id, so copies never make
    pairs; the table of nodes is joined to links and documents by plain shuffles that adaptive execution can split.

    Null and blank texts have fingerprint zero and link like others. Texts of fewer than ``words`` words are one
    shingle. Ids are integers; a row with a null id is placed in its component, and where a component has null ids
    only its id is null. Rows that repeat an id each get their row. An empty table gives an empty result; extra
    columns are ignored.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, words))
    nodes = materialise(fps.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    links = materialise(near_pairs(nodes.select("fp"), distance, hot_bucket))
    # fingerprints are the nodes of the links; the smallest id of a component is found at the end
    roots = components(links)
    classes = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "rep", "n", F.coalesce("root", "fp").alias("root")
    )
    classes = materialise(classes)
    ids = materialise(classes.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("component_size")))
    named = materialise(classes.join(ids, "root").select("fp", "component_id", "component_size"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return fps.join(named, "fp").select(
        F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id", "component_size"
    )
