"""Exact quartiles by selection on ranks.

Cuts divide the numbers of a column into buckets: what lies between two
neighbouring cuts, and each cut by itself. Rows are counted per bucket, which
tells for each rank that a quartile needs in which bucket it lies, whatever the
cuts are: good cuts make the buckets small, and no cut can miss a rank. Only the
buckets with such a rank, six per column at most, are then ranked.

With a table of counted values the cuts are quantiles of its distinct values.
Without one, a sketch encloses each quartile; the pass that counts the buckets
brings along the few values that are enclosed, so the table is read once more
only if a rank lies elsewhere, as in very small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

QUARTILES = (0.25, 0.5, 0.75)
NAMES = ("p25", "median", "p75")
#: Buckets of distinct values.
BUCKETS = 1024
SKETCH_ACCURACY = 10_000
#: Size of the quantile sketch, its greatest error in ranks, and the parts of a bracket, twice that wide on either side.
SKETCH_SIZE = 2048
SKETCH_ERROR = 0.002
PARTS = 32


def cuts_of_values(numbers: DataFrame) -> DataFrame:
    """``(position, cuts, pairs)`` from ``(position, v, n)`` with distinct values; no pairs."""
    # By `n`, so that the condition stays above the exchange that made the table.
    value = F.when(F.col("n") > 0, F.col("v"))
    cuts = numbers.groupBy("position").agg(F.percentile_approx(value, [i / BUCKETS for i in range(1, BUCKETS)], SKETCH_ACCURACY).alias("cuts"))
    return cuts.withColumn("pairs", F.lit(None).cast("array<double>"))


def bracket_ranks() -> list[float]:
    """Ranks around each quartile at which a bracket is cut, as shares."""
    step = 4 * SKETCH_ERROR / PARTS
    return [min(max(q - 2 * SKETCH_ERROR + i * step, 0.0), 1.0) for q in QUARTILES for i in range(PARTS + 1)]


def cuts_of_brackets(brackets: DataFrame) -> DataFrame:
    """The same from ``(position, edges)``: for each quartile as many values that enclose it, ascending."""
    per = F.floor(F.size("edges") / len(QUARTILES)).cast("int")
    pairs = F.array(*(F.get("edges", at) for q in range(len(QUARTILES)) for at in (q * per, (q + 1) * per - 1)))
    return brackets.select("position", F.array_sort(F.array_distinct("edges")).alias("cuts"), pairs.alias("pairs"))


def _placed(numbers: DataFrame, cuts: DataFrame, most: int) -> DataFrame:
    """``(position, bucket, v, held, n)``: buckets count up by value; ``held`` is a value between a pair.

    ``most`` is the greatest number of cuts of a column.
    """
    # One row per numeric column.
    near = numbers.join(F.broadcast(cuts), "position").withColumn("less", F.lit(0))
    step = 1 << (most.bit_length() - 1)
    while step:  # a binary search, one projection a step, so that each is worked out once
        smaller = F.coalesce(F.get("cuts", F.col("less") + (step - 1)) < F.col("v"), F.lit(False))
        near = near.withColumn("less", F.col("less") + F.when(smaller, step).otherwise(0))
        step //= 2
    equal = F.coalesce(F.get("cuts", F.col("less")) == F.col("v"), F.lit(False))
    held = F.lit(False)
    for q in range(len(QUARTILES)):
        held |= (F.col("v") >= F.get("pairs", F.lit(2 * q))) & (F.col("v") <= F.get("pairs", F.lit(2 * q + 1)))
    return near.select(
        "position",
        (2 * F.col("less") + equal.cast("int")).alias("bucket"),
        "v",
        F.when(F.coalesce(held, F.lit(False)), F.col("v")).alias("held"),
        "n",
    )


def quartiles_of(numbers: DataFrame, cuts: DataFrame, most: int = BUCKETS - 1) -> DataFrame:
    """``(position, p25, median, p75)``, linearly interpolated, of ``(position, v, n)``.

    Right for any cuts. Columns without numbers have no row. Equal neighbours
    need no step between them; between unequal infinities there is no number.
    """
    placed = _placed(numbers, cuts, most)
    counted = placed.groupBy("position", "bucket", "held").agg(F.sum("n").alias("n"))
    sizes = counted.groupBy("position", "bucket").agg(F.sum("n").alias("size"), F.count("held").alias("n_held"))
    upward = W.partitionBy("position").orderBy("bucket")
    everything = W.partitionBy("position")
    ahead = sizes.withColumn("ahead", F.sum("size").over(upward) - F.col("size")).withColumn("rows", F.sum("size").over(everything))
    ranks = [r(F.lit(q) * (F.col("rows") - 1)) for q in QUARTILES for r in (F.floor, F.ceil)]
    asked = F.exists(F.array(*ranks), lambda r: (F.col("ahead") <= r) & (r < F.col("ahead") + F.col("size")))
    # At most six per column.
    chosen = ahead.where(asked).select("position", "bucket", "ahead", "rows", "n_held")
    brought = counted.where("held IS NOT NULL").join(F.broadcast(chosen), ["position", "bucket"]).withColumnRenamed("held", "v")
    again = (
        placed.join(F.broadcast(chosen.where("n_held = 0")), ["position", "bucket"])
        .groupBy("position", "bucket", "ahead", "rows", "v")
        .agg(F.sum("n").alias("n"))
    )
    names = ["position", "bucket", "ahead", "rows", "v", "n"]
    inside = brought.select(names).unionByName(again.select(names))
    within = F.sum("n").over(W.partitionBy("position", "bucket").orderBy("v"))
    ranked = inside.withColumn("upto", F.col("ahead") + within)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto")), F.col("v")))

    picked = ranked.groupBy("position").agg(
        F.max("rows").alias("rows"),
        *(at(r(F.lit(q) * (F.col("rows") - 1))).alias(f"{name}_{side}") for q, name in zip(QUARTILES, NAMES) for r, side in ((F.floor, "low"), (F.ceil, "high"))),
    )

    def between(q: float, name: str) -> Column:
        low, high, place = F.col(f"{name}_low"), F.col(f"{name}_high"), F.lit(q) * (F.col("rows") - 1)
        fraction = place - F.floor(place)
        return F.when((low == high) | (fraction == 0), low).otherwise(low + (high - low) * fraction).alias(name)

    return picked.select("position", *(between(q, name) for q, name in zip(QUARTILES, NAMES)))
