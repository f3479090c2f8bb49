"""Near copies by exact shingle similarity: SimHash and min-hash bands propose pairs, the shingle sets decide.

Fingerprints within 3 bits, found by the multi-index tables of ``simhash``, are the closest copies. Texts at 0.8
similarity differ in some 10 of 64 bits, which no ball small enough to enumerate reaches; bands propose those.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, few, give_back, materialise, without
from .simhash import components, majority, near_pairs, shingle_hashes

SIMILAR = 0.8
#: Two sets of similarity s share no band with probability (1 - s^5)^25: 5 in 100,000 at 0.8, 4 in 10 million at 0.85.
BANDS, ROWS = 25, 5
#: Parts of the shingles whose numbers are compared before sets are.
PARTS = 16
BATCH_BYTES = 3_000_000

_RNG = np.random.Generator(np.random.PCG64(42))
_FLIP, _TIMES, _AGAIN = _RNG.integers(0, 2**64, (3, BANDS * ROWS, 1), np.uint64, endpoint=False) | np.uint64(1)


def bands(shingles: np.ndarray) -> list[int]:
    """The keys of the ``BANDS`` bands of a set of shingle hashes, as signed integers; a band's number is in its key."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 2048):
        h = (shingles[at : at + 2048] ^ _FLIP) * _TIMES
        h ^= h >> np.uint64(32)
        least = np.minimum(least, (h * _AGAIN).min(axis=1))
    raw = least.tobytes()
    keys = [xxhash.xxh64_intdigest(raw[i * ROWS * 8 : (i + 1) * ROWS * 8], i) for i in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def shingle_sets(docs: DataFrame, words: int = 5) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): ``id``, ``hash`` of the text, ``node``, ``fp``, ``size`` and ``bands``.

    Of the set of distinct 64-bit hashes of the text's runs of ``words`` words, A-Z lower-cased, ``node`` is a hash,
    ``size`` the number and ``bands`` the keys of its bands; ``fp`` is the text's SimHash. A shorter text is one
    shingle, and a null or blank one has none.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, fps, size, keys = [], [], [], []
            for text in batch.column(2):
                every = shingle_hashes(text.as_py() or b"", words)
                own = np.unique(every)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                fps.append(majority(every))
                size.append(len(own))
                keys.append(bands(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.array(node, np.uint64).view(np.int64)),
                    pa.array(fps, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["id", "hash", "node", "fp", "size", "bands"],
            )
            give_back()

    slim = docs.select(
        F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text")
    )
    return slim.mapInArrow(each, f"id {id_type}, hash long, node long, fp long, size long, bands array<long>")


def shingles_of(docs: DataFrame, hashes: DataFrame, words: int) -> DataFrame:
    """``node`` and ``s``, the set of shingle hashes, of the texts of ``docs`` whose hash is in ``hashes``, a written table."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(text.as_py() or b"", words)) for text in batch.column(0)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            ends = np.cumsum([0, *map(len, sets)], dtype=np.int32)
            flat = np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["node", "s"])
            give_back()

    wanted = docs.select(F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("text"))
    wanted = wanted.join(few(hashes), "hash", "left_semi").select("text")
    return wanted.mapInArrow(each, "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s"))


def close_fingerprints(sets: DataFrame, distance: int = 3) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes of ``sets`` (node, fp) that connect all whose fingerprints are ``distance`` bits apart at most."""
    nodes = materialise(sets.select("node", "fp").distinct())
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    same = nodes.join(first, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    links = near_pairs(first.select("fp"), distance)
    links = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    links = links.join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b").select("x", "y")
    return same.unionByName(links).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def open_pairs(named: DataFrame, own: DataFrame, similar: float) -> DataFrame:
    """Pairs ``a``, ``b`` of nodes of different components (``root``) that share a band (``key``) and may be similar.

    Members outside the most frequent component of a band meet all members of other components, where counts do not
    exclude that they are similar. A shingle that no other node of such bands has cannot be shared: with c shingles
    that may be, a node of size n is similar only to sizes from similar * n to c * (1 + similar) / similar - n, so
    nodes meet by band and class of size. And two sets differ in their unshared shingles and in the difference of
    their numbers of others in each of ``PARTS`` parts, dealt by hash; similar ones differ in at most
    (1 - similar) / (1 + similar) of both sizes. So the many variants of one text that each differ from it too much
    hardly become pairs.
    """
    most = (
        named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots"))
        .where("roots > 1").select("key", F.col("top.root").alias("major"))
    )
    several = materialise(named.join(most, "key"))
    x = own.join(several.select("node").distinct(), "node").select("node", F.explode("s").alias("x"))
    twice = x.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("x")
    part = F.pmod(F.xxhash64("x"), F.lit(PARTS))
    parts = [f"n{i}" for i in range(PARTS)]
    shared = x.join(twice, "x").groupBy("node").agg(
        F.count(F.lit(1)).alias("c"), *[F.count_if(part == i).alias(p) for i, p in enumerate(parts)]
    )
    t, n, c = F.lit(similar), F.col("size"), F.col("c")
    least, greatest = F.ceil(t * n - 1e-6), F.floor(F.least(n / t, c * (1 + t) / t - n) + 1e-6)
    live = materialise(several.join(shared, "node").withColumns({"least": least, "greatest": greatest}).where("least <= greatest"))

    def size_class(size: Column) -> Column:
        return F.floor(F.log(F.greatest(size, F.lit(1))) / math.log(1.04))

    minor = live.where("root <> major").select(
        "key", F.col("node").alias("m"), F.col("size").alias("m_size"), F.col("root").alias("m_root"),
        F.col("least").alias("m_least"), F.col("greatest").alias("m_greatest"), F.col("c").alias("m_c"), *[F.col(p).alias(f"m_{p}") for p in parts],
        F.explode(F.sequence(size_class(F.col("least")), size_class(F.col("greatest")))).alias("class"),
    )
    met = minor.join(live.withColumn("class", size_class(n)), ["key", "class"])
    met = met.where((F.col("root") != F.col("m_root")) & ((F.col("root") == F.col("major")) | (F.col("m") < F.col("node"))))
    met = met.where("size between m_least and m_greatest and m_size between least and greatest")
    differ = n + F.col("m_size") - c - F.col("m_c") + sum(F.abs(F.col(p) - F.col(f"m_{p}")) for p in parts)
    met = met.where(differ <= (n + F.col("m_size")) * (1 - t) / (1 + t) + 1e-6)
    return met.select(F.least("node", "m").alias("a"), F.greatest("node", "m").alias("b")).distinct()


def similar_links(docs: DataFrame, sets: DataFrame, words: int = 5, similar: float = SIMILAR) -> DataFrame:
    """Links ``a``, ``b`` that connect the nodes of ``sets``, a written table of ``docs``, exactly as all similar pairs do.

    A pair is similar when its shingle sets have an intersection of at least ``similar`` times their union. Nodes of
    close fingerprints are compared, and every two nodes that share a band, unless links found before connect them or
    their sizes and unshared shingles exclude it: first each node with the centre of its band, the member whose bands
    hold most others; then, in bands of more than one component by now, the ``open_pairs``. So a large group of copies
    of one text costs rows in proportion to its size. Shingles are written only for nodes that share a band.
    """
    owners = materialise(sets.select("node", "size", F.explode("bands").alias("key")).distinct())
    counts = owners.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = materialise(owners.join(counts, "key"))
    reach = shared.groupBy("node").agg(F.sum("n").alias("reach"))
    centre = shared.join(reach, "node").groupBy("key").agg(F.max(F.struct("reach", "node", "size")).alias("c"))
    centre = centre.select("key", F.col("c.node").alias("centre"), F.col("c.size").alias("c_size"))
    close = materialise(close_fingerprints(sets))
    need = shared.select("node").union(close.select("a")).union(close.select("b")).distinct()
    hashes = materialise(sets.select("node", "hash").join(need, "node").groupBy("node").agg(F.min("hash").alias("hash")).select("hash"))
    own = materialise(shingles_of(docs, hashes, words))

    def verified(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("s", "t"))
        return materialise(
            pairs.join(own.withColumnRenamed("node", "a"), "a")
            .join(own.select(F.col("node").alias("b"), F.col("s").alias("t")), "b")
            .where(both / (F.size("s") + F.size("t") - both) >= similar)
            .select("a", "b")
        )

    fits = F.least("size", "c_size") / F.greatest("size", "c_size") >= similar  # else no intersection is large enough
    first = materialise(
        shared.join(centre, "key")
        .where((F.col("node") != F.col("centre")) & fits)
        .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        .unionByName(close)
        .distinct()
    )
    found = verified(first)
    known = components(found).withColumnRenamed("root", "known")
    named = materialise(
        shared.select("key", "node", "size").join(known, "node", "left").select("key", "node", "size", F.coalesce("known", "node").alias("root"))
    )
    return found.unionByName(verified(open_pairs(named, own, similar).join(first, ["a", "b"], "left_anti")))


def drop_near_copies(docs: DataFrame, words: int = 5, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each component of similar texts, that of the smallest id.

    Texts are similar when the sets of their runs of ``words`` words have a Jaccard similarity of at least
    ``similar``. Texts of equal sets are one node, so blank and null texts are similar to each other. An id may come
    with several texts: each row goes or stays by its own text, and one row of a component stays. Null ids stay only
    where no other id is in their component. Very long texts are compared whole. An empty table gives an empty
    result; all columns come along, whatever their names.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        sets = materialise(shingle_sets(docs, words))
        roots = components(similar_links(docs, sets, words, similar)).withColumnRenamed("root", "found")
    rows = materialise(sets.select("id", "hash", "node").join(roots, "node", "left").select("id", "hash", F.coalesce("found", "node").alias("root")))
    # of each component the smallest id stays (a null one if there is no other), and of its rows that of the smallest hash
    best = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "hash"))).alias("best")
    chosen = rows.groupBy("root").agg(best, F.min("hash").alias("least"))
    chosen = chosen.select("root", F.col("best.id").alias("kept"), F.coalesce("best.hash", "least").alias("kept_hash"))
    stays = F.col("id").eqNullSafe(F.col("kept")) & (F.col("hash") == F.col("kept_hash"))
    marked = rows.join(chosen, "root").groupBy("id", F.col("hash").alias("key"), stays.alias("one")).agg(F.count(F.lit(1)).alias("n"))
    return without(docs, marked.where("not one or n > 1").select("id", "key", "one"), F.xxhash64("text"))
