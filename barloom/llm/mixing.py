"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, buckets, few, materialise

PER_GROUP = 4096


def word_count(text: Column) -> Column:
    """Words of a text (runs of characters other than blanks); null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source of ``sizes`` (source, size): ``n``, ``source_size`` and ``target``.

    Sources by code point, null last, take the ``weights`` in turn. They share ``share`` times the total by weight;
    no target passes ``most`` times its source's size, and what is cut off is shared again by weight among the
    rest. That ends where a level t gives target = min(cap, weight * t): with sources in order of cap / weight, the
    first k are at their caps and t = (total - their caps) / (weights of the rest), for the smallest k that fits.
    Only the one row per source meets in one task here, never documents.
    """
    s = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    s = s.withColumn("w", weight).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        s.withColumn("total", F.sum("source_size").over(everything) * float(share))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("t", F.col("left") / F.col("w_left"))
        .withColumn("free", F.col("w") * F.col("t") < F.col("cap"))
        # the first free source sets the level for itself and all after it
        .withColumn("level", F.min_by("t", F.when(F.col("free"), F.col("cap") / F.col("w"))).over(everything))
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level")))
    return s.select("source", "n", "source_size", target.alias("target"))


def _pivot(p: list[float], size: list[float], u: list[float]) -> None:
    """Round the probabilities ``p`` in place, in order, by duels between neighbours; one may stay open.

    A duel moves ``size``-weighted mass between two open probabilities until one is 0 or 1. The side that gains is
    drawn so that every expectation stays, and the sum of size * p stays exactly.
    """
    i = -1
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if i < 0:
            i = j
            continue
        room_i, room_j = (1.0 - p[i]) * size[i], (1.0 - p[j]) * size[j]
        mass_i, mass_j = p[i] * size[i], p[j] * size[j]
        up, down = min(room_i, mass_j), min(mass_i, room_j)
        if u[j] * (up + down) < down:  # i takes mass from j
            i_done = room_i <= mass_j
            p[i], p[j] = (1.0, p[j] - up / size[j]) if i_done else (p[i] + up / size[i], 0.0)
        else:
            i_done = mass_i <= room_j
            p[i], p[j] = (0.0, p[j] + down / size[j]) if i_done else (p[i] - down / size[i], 1.0)
        i = j if i_done else i
        if not 1e-12 < p[i] < 1.0 - 1e-12:
            p[i] = float(round(p[i]))
            i = -1


def _round_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("size", "descending"), ("draw", "ascending"), ("hash", "ascending")])
    p = rows["p"].to_pylist()
    _pivot(p, rows["size"].to_pylist(), [d / 2.0**32 for d in rows["draw"].to_pylist()])
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def _parted(open_: DataFrame, per_group: int) -> tuple[DataFrame, bool]:
    """``open_`` with ``part``, and whether there is more than one: a bucket twice as large as ``per_group`` is dealt by row number.

    Only rows that repeat an id and its text make a bucket so large, as they share a hash.
    """
    large = open_.groupBy("source", "bucket").count().where(F.col("count") > 2 * per_group)
    large = materialise(large.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.ceil(F.col("count") / per_group).alias("parts")))
    if large.isEmpty():
        return open_.withColumn("part", F.lit(0).cast("long")), False
    at = open_["source"].eqNullSafe(large["s"]) & (open_["bucket"] == large["b"])
    part = F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1)))
    return open_.join(large, at, "left").withColumn("part", part).drop("s", "b", "parts"), True


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    per_group: int = PER_GROUP,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, ``source``, ``size`` in words, ``source_size``, ``target``, ``copies``, ``taken``.

    A document is wanted target / source_size times on average. The whole part of that is taken as copies; the rest
    is a probability that pivotal rounding turns into 0 or 1. Rounding runs in groups of about ``per_group``
    documents of one source, so a hot source is many groups. Each group leaves at most one probability open, and
    these residuals meet in groups again, level by level, until a source has one group; its last residual is rounded
    to the nearer side. As duels keep size * p, a source's words miss its target by half a document at most; and as
    they go from long documents to short ones, the one that is left is mostly short.

    Groups, order and draws come from hashes of ids, texts and ``seed``, so a rerun agrees on any cluster. Null texts
    and texts without words have size 0 and are taken 0 words (their copies follow the whole part); null sources
    are one source, the last; rows that repeat an id, or have none, are documents of their own, told apart by their
    texts, and rows of one id and one text by their place in the input, which decides only between them; an empty table gives an empty result. Extra columns are
    ignored, but ``row_col``, a long that tells rows apart, comes along where it is named.
    """
    sized = materialise(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("hash"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).cast("long").alias("row"),
        )
    )
    targets = materialise(source_targets(sized, weights, share, most))
    most_rows = targets.agg(F.max("n")).first()[0] or 0
    levels = [buckets(most_rows, per_group)]
    while levels[-1] > 1:
        levels.append(buckets(levels[-1], per_group))
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    # a source is one row of targets: bounded by the number of sources, joined by whatever its size allows
    rows = (
        sized.join(targets, sized["source"].eqNullSafe(targets["source"]))
        .drop(targets["source"])
        .withColumn("rate", rate)
        .withColumn("base", F.floor("rate"))
        .withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("base")).otherwise(F.lit(0.0)))
        .withColumn("draw", F.shiftrightunsigned("hash", 32).cast("double"))
        .withColumn("bucket", F.pmod(F.col("hash"), F.ceil(F.col("n") / F.lit(per_group))))
    )
    shape = "id long, source string, size long, source_size long, target double, base long, p double, hash long, draw double, bucket long, row long"
    shape = shape.replace("id long", f"id {sized.schema['id'].dataType.simpleString()}", 1)
    names = [x.split()[0] for x in shape.split(", ")]
    done, open_, level, split = [], rows.select(names), 0, True
    while level < len(levels) or split:
        dealt, split = _parted(open_, per_group)
        rounded = materialise(dealt.groupBy("source", "bucket", "part").applyInArrow(_round_group, f"{shape}, part long")).drop("part")
        is_open = (F.col("p") > 0) & (F.col("p") < 1)
        level += 1
        if level >= len(levels) and not split:
            rounded = rounded.withColumn("p", F.when(is_open, F.round("p")).otherwise(F.col("p")))
            done.append(rounded)
        else:
            done.append(rounded.where(~is_open))
            open_ = (
                rounded.where(is_open)
                .withColumn("draw", F.shiftrightunsigned(F.xxhash64("hash", F.lit(level - 1)), 32).cast("double"))
                .withColumn("bucket", F.floor(F.col("bucket") / per_group))
            )
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = (F.col("base") + F.col("p")).cast("long")
    return out.select(
        F.col("id").alias(id_col),
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *([F.col("row").alias(row_col)] if row_col else []),
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document of two copies twice, one of none not at all.

    Every row has its own decision, also where ids are null or repeat: rows are numbered and written first, and copies
    come back to them by that number. Rows without words follow the whole part of their source's rate; null sources
    are one source. An empty table gives an empty result; all columns come along, whatever their names.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    own = {c: f"_{docs.columns.index(c)}" for c in ("doc_id", "text", "source")}
    rows = materialise(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()))
    mix = mix_sources(rows, own["doc_id"], own["text"], own["source"], row_col="row", **options)
    copies = materialise(mix.where("copies > 0").select("row", "copies"))
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return rows.join(few(copies), "row").select(*names, again).select(names).toDF(*docs.columns)
