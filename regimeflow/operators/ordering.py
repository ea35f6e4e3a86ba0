"""Total order without a single-partition sort, and the operators that lean on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from regimeflow.scratch import materialize

BLOCK_ROWS = 8192
LITERAL_PARTS = 2048
_ROW_BITS = (1 << 33) - 1  # low bits of monotonically_increasing_id: the row's position in its partition


def range_sorted(df: DataFrame, order_cols: list[str], partitions: int | None = None) -> DataFrame:
    """Range-partitioned by ``order_cols`` and sorted inside each partition.

    The row id closes the key, so one time value held by a third of the rows still spreads over partitions.
    A given number of partitions is kept; otherwise small neighbours are merged at run time.
    """
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    count = [partitions] if partitions else []
    return keyed.repartitionByRange(*count, *order_cols, "_tie").sortWithinPartitions(*order_cols, "_tie").drop("_tie")


def require_unique(df: DataFrame, order_cols: list[str]) -> None:
    repeated = df.groupBy(*order_cols).count().where("count > 1").limit(1)
    if not repeated.isEmpty():
        raise ValueError(f"{order_cols} do not identify a row: {repeated.first()}")


def partition_offsets(table: DataFrame, **rows: Column) -> dict[str, tuple[dict[int, int], int]]:
    """Per named row count: (exclusive running count per ``part``, total).

    The driver sees one row per shuffle partition, whatever the data size.
    """
    counted = table.groupBy("part").agg(*[c.alias(name) for name, c in rows.items()]).collect()
    counted.sort(key=lambda r: r["part"])
    out = {}
    for name in rows:
        offsets, total = {}, 0
        for r in counted:
            offsets[r["part"]] = total
            total += r[name]
        out[name] = (offsets, total)
    return out


def with_offset(table: DataFrame, offsets: dict[int, int], into: str) -> DataFrame:
    """Adds the offset of the row's ``part``: from a literal array, or a join once there are many partitions."""
    if len(offsets) <= LITERAL_PARTS and max(offsets, default=0) <= LITERAL_PARTS:
        listed = ",".join(str(offsets.get(i, 0)) for i in range(max(offsets, default=0) + 1))
        return table.withColumn(into, F.get(F.expr(f"cast(split('{listed}', ',') as array<bigint>)"), F.col("part")))
    rows = table.sparkSession.createDataFrame(list(offsets.items()), f"part int, {into} long")
    return table.join(F.broadcast(rows), "part")  # one small row per partition


def number_rows(df: DataFrame, order_cols: list[str], validate: bool = False) -> tuple[DataFrame, int]:
    """(``df`` with ``seq``: dense, 0-based, following ``order_cols``; number of rows).

    ``order_cols`` should identify a row; rows that share all of them keep an arbitrary relative order.
    ``validate`` raises when they do not.  One range shuffle, one written table, no global window.
    """
    if validate:
        require_unique(df, order_cols)
    placed = (
        range_sorted(df, order_cols)
        .withColumn("part", F.spark_partition_id())
        .withColumn("pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS)))
    )
    table = materialize(placed, "ordered")
    offsets, n_rows = partition_offsets(table, n=F.count("*"))["n"]
    numbered = with_offset(table, offsets, "_offset").withColumn("seq", F.col("_offset") + F.col("pos"))
    return numbered.drop("part", "pos", "_offset"), n_rows


def assign_seq(df: DataFrame, order_cols: list[str], validate: bool = False) -> DataFrame:
    return number_rows(df, order_cols, validate)[0]


def sort_by_time(df: DataFrame, order_cols: list[str]) -> DataFrame:
    """Ascending sort.  Without the time column the table comes back as it is."""
    if any(c not in df.columns for c in order_cols):
        return df
    return df.orderBy(*order_cols)


def forward_fill(df: DataFrame, values: str | list[str], fallback: Column | None = None, seq: str = "seq",
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Replaces nulls of each of ``values`` by the latest non-null at or before the row; leading nulls take ``fallback``.

    Blocks fill themselves for all columns in one pass and are written; what leaves a block stands in its last row.
    What enters a block is the same problem on one row per block, so it recurses on a table ``block_rows`` times smaller
    and comes back through an equi-join on the block, broadcast while it is small.
    """
    values = [values] if isinstance(values, str) else list(values)
    filled = _fill(df, values, seq, block_rows)
    return filled if fallback is None else filled.withColumns({v: F.coalesce(F.col(v), fallback) for v in values})


def _fill(df: DataFrame, values: list[str], seq: str, block_rows: int, level: int = 0) -> DataFrame:
    block = f"_block{level}"
    running = W.partitionBy(block).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    blocked = df.withColumn(block, F.floor(F.col(seq) / block_rows))
    local = materialize(blocked.withColumns({v: F.last(v, ignorenulls=True).over(running) for v in values}), "filled")
    # What stands in the last row of block b is what block b + 1 starts from.
    carried = {v: f"_carry{level}_{i}" for i, v in enumerate(values)}
    ends = local.where(F.col(seq) % block_rows == block_rows - 1)
    entering = ends.select((F.col(block) + 1).alias(block), *[F.col(v).alias(c) for v, c in carried.items()])
    n = entering.count()
    if not n:
        return local.drop(block)
    if n > 1:
        entering = _fill(entering, list(carried.values()), block, block_rows, level + 1)
    return local.join(entering, block, "left").withColumns({v: F.coalesce(F.col(v), F.col(c)) for v, c in carried.items()}).drop(block, *carried.values())


def previous_row(df: DataFrame, value: str, into: str, seq: str = "seq", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the previous row's ``value`` (null on the first row).

    A block's last row is also sent to the next block as a halo, so a plain ``lag`` inside each block is exact.
    """
    block = F.floor(F.col(seq) / block_rows)
    is_last = F.col(seq) % block_rows == block_rows - 1
    copies = df.withColumn("_block", F.explode(F.when(is_last, F.array(block, block + 1)).otherwise(F.array(block))))
    inside = W.partitionBy("_block").orderBy(seq)
    return (
        copies.withColumn(into, F.lag(value).over(inside))
        .where(F.col("_block") == block)
        .drop("_block")
    )


def window_ids(seq: Column, n_rows: int, size: int, stride: int) -> Column:
    """Ids of the overlapping row windows (starts 0, stride, ..., at most ``n_rows - size``) that hold ``seq``.

    Empty where there is none: rows past the last full window, or between windows when stride > size.
    """
    last = (n_rows - size) // stride if n_rows >= size else -1
    low = F.greatest(F.lit(0), F.ceil((seq - size + 1) / F.lit(stride))).cast("long")
    high = F.least(F.floor(seq / F.lit(stride)), F.lit(last)).cast("long")
    # sequence() would count downwards from low to high, so an empty span is spelled out.
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def sliding_windows(df: DataFrame, size: int, stride: int | None = None, seq: str = "seq", n_rows: int | None = None) -> DataFrame:
    """One copy of a row per window that holds it, tagged ``window_id``; the stride defaults to half a window."""
    stride = stride or size // 2
    if n_rows is None:
        top = df.agg(F.max(seq)).first()[0]
        n_rows = 0 if top is None else top + 1
    return df.withColumn("window_id", F.explode(window_ids(F.col(seq), n_rows, size, stride)))


TOP_COLUMNS = ("shock_score", "regime", "delta", "recon_error")


def top_shocks(
    scored: DataFrame, n: int = 10, time_col: str | None = None, group_col: str | None = None, seq: str = "seq"
) -> DataFrame:
    """The ``n`` highest scores, the earlier row first on ties; group and time lead the columns."""
    present = set(scored.columns)
    columns = [*[c for c in (group_col, time_col) if c in present], *TOP_COLUMNS]
    ranked = F.when(~F.isnan("shock_score"), F.col("shock_score"))  # NaN would sort above every score
    return scored.orderBy(ranked.desc_nulls_last(), F.col(seq).asc()).limit(n).select(*columns)
