"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.common import let


BROADCAST_ROWS = 100_000  # of frames with one short row per source, bucket or block


def shares_by_temperature(docs: DataFrame, power: float = 0.5, total: int = 1000) -> DataFrame:
    """Target weights as integers: in proportion to rows to the ``power``, about ``total`` together, at least 1 each."""
    counts = docs.groupBy("source").agg(F.count("*").alias("__n"))
    raised = counts.withColumn("__w", F.pow("__n", F.lit(power)))
    summed = Window.partitionBy()
    share = F.greatest(F.lit(1), F.round(total * F.col("__w") / F.sum("__w").over(summed))).cast("long")
    return raised.select("source", share.alias("share"))


def _cycle(shares: Column, period: Column) -> Column:
    """Which source has each slot of one period: array of places in ``shares``.

    Block k (from 0) of a source with share s of period p is released at floor(k p / s) and due before
    ceil((k + 1) p / s). Every slot goes to the released block with the earliest deadline, ties to the first source. The
    shares add up to the period, so every block meets its deadline and no source is ever a whole block ahead or behind.
    """

    def step(state: Column, slot: Column) -> Column:
        def due(share: Column, i: Column) -> Column:
            k = F.element_at(state["taken"], (i + 1).cast("int"))
            released = F.floor(k * period / share) <= slot
            return F.when(released, F.struct(F.ceil((k + 1) * period / share).alias("due"), i.cast("int").alias("i")))

        first = F.array_min(F.filter(F.transform(shares, due), lambda d: d.isNotNull()))
        return let(
            first["i"],
            lambda i: F.struct(
                F.transform(state["taken"], lambda t, k: F.when(k == i, t + 1).otherwise(t)).alias("taken"),
                F.array_append(state["picked"], i).alias("picked"),
            ),
        )

    start = F.struct(
        F.transform(shares, lambda s: F.lit(0).cast("long")).alias("taken"),
        F.array().cast("array<int>").alias("picked"),
    )
    return F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda state: state["picked"])


def mix(docs: DataFrame, shares: DataFrame | None = None, block: int = 64, bucket: int = 5_000) -> DataFrame:
    """Order all rows so that the sources interleave in blocks by their target weights.

    ``shares`` (source, share) gives integer weights, by default :func:`shares_by_temperature`; a source without one
    has share 1. The rows of a source, in the order of md5(doc_id|text), are cut into blocks of ``block`` rows (the last may be
    shorter). Blocks are placed by the periodic Pfair schedule, in which after any number of slots each source has had
    its share of them to within less than one block. A source whose blocks run out leaves its slots and the others close
    up, so every row appears exactly once and the rest keep their proportions.

    Adds ``block`` (in the source), ``slot`` (place of the block, from 0, no gaps) and ``position`` (place of the row, from 0, no
    gaps); columns of these names are replaced. A null source is a source of its own, a null id or text counts as empty in the
    order, equal rows are interchangeable, an empty table gives no rows.

    Rows are numbered inside buckets of about ``bucket`` rows that follow the order, so a hot source is split over many
    tasks. The schedule takes sources x shares steps in one row; the blocks are one row per ``block`` rows. What is known of
    sources, buckets and blocks is broadcast to the rows while it is at most BROADCAST_ROWS rows, and joined by its keys beyond.
    """
    shares = shares_by_temperature(docs) if shares is None else shares
    weights = shares.groupBy(F.col("source").alias("__weighted")).agg(F.max("share").cast("long").alias("__given"))
    sources = (
        docs.groupBy(F.col("source").alias("__source"))
        .agg(F.count("*").alias("__n"))
        .join(weights, F.col("__source").eqNullSafe(F.col("__weighted")), "left")
        .select("__source", "__n", F.greatest(F.lit(1), F.coalesce("__given", F.lit(1))).alias("__share"))
    )
    sizes = sources.agg(F.count("*"), F.sum(F.ceil(F.col("__n") / bucket)), F.sum(F.ceil(F.col("__n") / block))).first()
    few = [F.broadcast if (n or 0) <= BROADCAST_ROWS else (lambda frame: frame) for n in sizes]
    # One row: all sources with their counts and shares, and the schedule of one period.
    held = F.array_sort(F.collect_list(F.struct("__source", "__n", "__share")))
    plan = sources.agg(held.alias("all")).where(F.size("all") > 0)
    plan = plan.withColumn("period", F.aggregate("all", F.lit(0).cast("long"), lambda t, s: t + s["__share"]))
    plan = plan.withColumn("cycle", _cycle(F.transform("all", lambda s: s["__share"]), F.col("period")))
    slots = F.filter(
        F.transform("cycle", lambda i, at: F.when(i == F.col("i"), at.cast("long"))), lambda at: at.isNotNull()
    )
    each = (
        plan.select("period", "cycle", F.posexplode("all").alias("i", "s"))
        .select("period", "s.*", slots.alias("slots"))
        .select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / block))).alias("__block"))
        .select(
            "__source",
            "__block",
            F.floor(F.col("__block") / F.col("__share")).alias("__round"),
            F.element_at("slots", (F.col("__block") % F.col("__share") + 1).cast("int")).alias("__at"),
            F.least(F.lit(block), F.col("__n") - F.col("__block") * block).alias("__rows"),
        )
    )
    # Rows and blocks before each period follow from the counts alone.
    before = lambda s, r: F.least(s["__n"], r * s["__share"] * block)
    blocks_before = lambda s, r: F.least(F.ceil(s["__n"] / block), r * s["__share"])
    zero = F.lit(0).cast("long")
    rounds = F.array_max(F.transform("all", lambda s: F.floor((F.ceil(s["__n"] / block) - 1) / s["__share"])))
    periods = plan.select("all", F.explode(F.sequence(zero, rounds)).alias("__of")).select(
        "__of",
        F.aggregate("all", zero, lambda t, s: t + before(s, F.col("__of"))).alias("__rows_before"),
        F.aggregate("all", zero, lambda t, s: t + blocks_before(s, F.col("__of"))).alias("__blocks_before"),
    )
    inside = Window.partitionBy("__round").orderBy("__at")
    placed = (
        each.withColumn("__rank", F.row_number().over(inside) - 1)
        .withColumn("__sum", F.sum("__rows").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(periods, F.col("__round") == F.col("__of"))
        .select(
            F.col("__source").alias("__placed"),
            F.col("__block").alias("__place"),
            (F.col("__blocks_before") + F.col("__rank")).alias("__slot"),
            (F.col("__rows_before") + F.col("__sum") - F.col("__rows")).alias("__start"),
        )
    )
    text = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    split = sources.select(F.col("__source").alias("__of"), F.ceil(F.col("__n") / bucket).alias("__buckets"))
    bucketed = (
        docs.withColumn("__order", F.md5(text))
        .join(few[0](split), F.col("source").eqNullSafe(F.col("__of")))
        .withColumn("__high", F.conv(F.substring("__order", 1, 8), 16, 10).cast("long"))
        .withColumn("__bucket", F.shiftright(F.col("__high") * F.col("__buckets"), 32))
        .drop("__of", "__high", "__buckets")
    )
    own = Window.partitionBy("source", "__bucket").orderBy("__order")
    earlier = Window.partitionBy("__of").orderBy("__in").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy(F.col("source").alias("__of"), F.col("__bucket").alias("__in"))
        .agg(F.count("*").alias("__n"))
        .select("__of", "__in", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    numbered = (
        bucketed.withColumn("__rank", F.row_number().over(own) - 1)
        .join(few[1](offsets), F.col("source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__in")))
        .withColumn("__number", F.col("__before") + F.col("__rank"))
    )
    same = F.col("source").eqNullSafe(F.col("__placed")) & (F.floor(F.col("__number") / block) == F.col("__place"))
    kept = [name for name in docs.columns if name not in ("block", "slot", "position")]
    return numbered.join(few[2](placed), same).select(
        *kept,
        F.col("__place").alias("block"),
        F.col("__slot").alias("slot"),
        (F.col("__start") + F.col("__number") % block).alias("position"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """The rows in the order of the mix: each file holds a run of positions."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
