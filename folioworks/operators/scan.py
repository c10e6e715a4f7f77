"""Ordered scans over long groups.

A running sum or a look at the previous row needs the rows of a group in order. When one group may
hold a third of all rows it must not be one task's work, so a long group is cut into blocks by its
rank. Windows run inside blocks; one small row per block carries what a block needs from those
before it. The result equals a window over the whole group. Where a first, narrow count finds no
long group the scan is that plain window, with a single exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioworks.session import cut_lineage

ROWS_PER_BLOCK = 100_000
#: Ranges that small blocks are dealt to at most, while these hold no more than ``ROWS_PER_BLOCK`` rows.
RANGES = 64


def _same(keys: list[str], prefix: str) -> list[Column]:
    """Null-safe equality: a missing key is a group of its own."""
    return [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys]


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the longest group and of the table. Reads the keys only."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    found = sizes.agg(F.max("_n").alias("longest"), F.sum("_n").alias("total")).first()
    return found["longest"] or 0, found["total"] or 0


def with_blocks(
    df: DataFrame, keys: list[str], order: list[str], rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame | None:
    """``df`` with ``_block``, or None when every group is short.

    Rows are cut by rank: a range partitioning over keys and all order columns (sampled quantiles), where a block is
    what one key has in one partition. So neither an outlier nor a column of one value makes a block larger; only rows
    that are equal in keys and order stay together. Blocks of few rows are cut out of sorted ranges by their rows'
    numbers there, for every range costs the driver a sample of the rows and the results of its tasks. What is cut is
    written to the shared folder first, so the input is computed twice at most: for the sizes, and for that.
    """
    longest, total = group_sizes(df, keys)
    if longest <= rows_per_block:
        return None
    blocks = max(2, -(-total // rows_per_block))
    ranges = min(blocks, max(RANGES, -(-total // ROWS_PER_BLOCK)))
    placed = cut_lineage(df).repartitionByRange(ranges, *keys, *order)
    block = F.spark_partition_id().cast("bigint")
    if ranges < blocks:
        placed = placed.sortWithinPartitions(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
        row = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))  # such an id has the row's number in its last 33 bits
        block = F.shiftleft(block, 33) + F.floor(row / rows_per_block)
    return cut_lineage(placed.withColumn("_block", block).drop("_m"))


def ordered_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    previous: dict[str, str] | None = None,
    rows_per_block: int | None = ROWS_PER_BLOCK,
    climbs: dict[str, tuple[Column, Column]] | None = None,
) -> DataFrame:
    """Add running sums, previous-row values and climbing maxima along ``order`` within ``keys``.

    ``sums`` maps a new column to the expression summed up
    to and including the row; ``previous`` maps a new column to the column read one row before; ``climbs`` maps a new
    column to (value, step), where the step is the same in a whole group: the column is max(value, previous + step),
    in closed form the running maximum of ``value - rank * step`` plus ``rank * step``.
    ``rows_per_block=None`` says that every group is known to be short.
    """
    sums, previous, climbs = sums or {}, previous or {}, climbs or {}
    valued = df.withColumns({f"_v_{name}": expr for name, expr in sums.items()})
    valued = valued.withColumns({f"_v_{name}": value for name, (value, _) in climbs.items()})
    valued = valued.withColumns({f"_d_{name}": step for name, (_, step) in climbs.items()})
    rows = None if rows_per_block is None else with_blocks(valued, keys, order, rows_per_block)
    if rows is None:
        over = Window.partitionBy(*keys).orderBy(*order)
        valued = valued.withColumn("_i", F.row_number().over(over)) if climbs else valued
        upto = over.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return valued.select(
            *df.columns,
            *[F.sum(f"_v_{name}").over(upto).alias(name) for name in sums],
            *[F.lag(src).over(over).alias(name) for name, src in previous.items()],
            *[_climb(name, upto).alias(name) for name in climbs],
        )
    return _blocked(df.columns, rows, keys, order, sums, previous, climbs)


def _climb(name: str, upto) -> Column:
    """The climbing maximum over a window whose rows have the ranks ``_i``."""
    steps = F.col("_i") * F.col(f"_d_{name}")
    return F.max(F.col(f"_v_{name}") - steps).over(upto) + steps


def _blocked(columns, rows, keys, order, sums, previous, climbs) -> DataFrame:
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    totals = [F.sum(f"_v_{name}").alias(f"_t_{name}") for name in sums]
    lasts = (
        [F.max_by(F.struct(*sorted(set(previous.values()))), F.struct(*order)).alias("_last")] if previous else []
    )
    if climbs:
        rows = rows.withColumn("_i", F.row_number().over(inside))
    # The largest value of a block less the steps from its beginning, and its number of rows.
    reached = [
        column
        for name in climbs
        for column in (
            F.max(F.col(f"_v_{name}") - F.col("_i") * F.col(f"_d_{name}")).alias(f"_m_{name}"),
            F.max(f"_d_{name}").alias(f"_d_{name}"),
        )
    ]
    count = [F.count(F.lit(1)).alias("_n")] if climbs else []
    per_block = rows.groupBy(*keys, "_block").agg(*totals, *lasts, *reached, *count)

    over = Window.partitionBy(*keys).orderBy("_block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    if climbs:
        per_block = per_block.withColumn("_f", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    carried = per_block.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*keys, "_block"]],
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
        *([F.lag("_last").over(over).alias("_carry")] if previous else []),
        *[_before_block(name, before).alias(f"_c_{name}") for name in climbs],
    )

    local = rows.select(
        "*",
        *[F.sum(f"_v_{name}").over(upto).alias(f"_s_{name}") for name in sums],
        *([F.row_number().over(inside).alias("_rn")] if previous else []),
        *[F.lag(src).over(inside).alias(f"_p_{name}") for name, src in previous.items()],
        *[_climb(name, upto).alias(f"_l_{name}") for name in climbs],
    )
    joined = local.join(carried, _same([*keys, "_block"], "_k_"))
    return joined.select(
        *[F.col(x) for x in columns],
        *[(F.col(f"_s_{name}") + F.col(f"_o_{name}")).alias(name) for name in sums],
        *[
            F.when(F.col("_rn") == 1, F.col(f"_carry.{src}")).otherwise(F.col(f"_p_{name}")).alias(name)
            for name, src in previous.items()
        ],
        *[
            F.greatest(f"_l_{name}", F.col(f"_c_{name}") + F.col("_i") * F.col(f"_d_{name}")).alias(name)
            for name in climbs
        ],
    )


def _before_block(name: str, before) -> Column:
    """What the climb has reached at the last row before a block, of which there are ``_f``; NULL before the first."""
    step = F.col(f"_d_{name}")
    return F.max(F.col(f"_m_{name}") - F.col("_f") * step).over(before) + F.col("_f") * step


def with_positions(df: DataFrame, order: list[str], name: str = "position") -> DataFrame:
    """Number all rows from 0 along ``order``, without gaps, as tasks that each see their own range only.

    Rows are dealt by sampled ranges of ``order``, sorted and numbered in their partition, and written to the shared
    folder; the partitions' row counts (a row for each) then shift the numbers. One exchange, and no window without a
    partition. NULLs come first; rows that are equal in ``order`` get their numbers in no particular order.
    """
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    local = cut_lineage(ranged.withColumn("_m", F.monotonically_increasing_id()))
    block = F.shiftright("_m", 33)  # such an id is the number of the partition and, in 33 bits, that of the row
    counts = local.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))  # a row for each partition
    firsts = counts.select("_b", F.coalesce(before, F.lit(0)).alias("_f"))
    placed = local.withColumn("_b", block).join(F.broadcast(firsts), "_b")
    rank = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.col("_f") + rank).alias(name))


def join_texts(
    df: DataFrame, keys: list[str], order: str, text: str, sep: str, name: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """(keys, ``name``): the texts of a group joined in order. Long groups are joined block by block first."""
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'")

    def joined(column: str, by: str) -> Column:
        return F.expr(f"listagg(`{column}`, '{quoted}') WITHIN GROUP (ORDER BY `{by}`)")

    rows = with_blocks(df.select(*keys, order, text), keys, [order], rows_per_block)
    if rows is None:
        return df.groupBy(*keys).agg(joined(text, order).alias(name))
    parts = rows.groupBy(*keys, "_block").agg(joined(text, order).alias("_part"))
    return parts.groupBy(*keys).agg(joined("_part", "_block").alias(name))
