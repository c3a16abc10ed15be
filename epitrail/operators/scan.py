"""Order over the lines of files of any size: places, running sums and what was last seen, carried from split to split.

Files are read in splits, in parallel. A line is known by its file, the split's first byte (``block``) and a number that rises within the split (``n``). A scan works
within each block first; a figure or two a block then go through a second, small scan over the blocks of each file, and come back to the block's lines. So nothing
that grows with a file goes through one task, and lines are shuffled once, by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ("file", "block")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, n, line`` of text files."""
    read = spark.read.text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))


def carried(lines: DataFrame, marks: dict[str, Column], sums: dict[str, Column] | None = None, previous: dict[str, Column] | None = None, since: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """``lines`` with a column for each of these:

    ``marks``: the last value, up to the line itself, that was not null; ``sums``: the sum over all lines before the line; ``previous``: the value of the line before;
    ``since``: by a mark's name and a sum's, that sum over the lines from the one that last set the mark to before the line.
    Null where there is none yet; a sum is then 0.
    """
    sums, previous, since = sums or {}, previous or {}, since or {}
    within = Window.partitionBy(*PLACE).orderBy("n")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    given = {f"_{name}": value for name, value in {**marks, **sums, **previous}.items()}
    valued = lines.withColumns(given)
    scanned = valued.withColumns(
        {f"_at_{m}": F.last(f"_{m}", ignorenulls=True).over(within) for m in marks}
        | {f"_at_{s}": F.coalesce(F.sum(f"_{s}").over(before), F.lit(0)) for s in sums}
        | {f"_at_{p}": F.lag(f"_{p}").over(within) for p in previous}
        | {"_first": F.row_number().over(within) == 1}
    )
    if since:  # what the sum had come to, in its block, where the mark was set
        scanned = scanned.withColumns({f"_at_{x}": F.last(F.when(F.col(f"_{m}").isNotNull(), F.col(f"_at_{s}")), ignorenulls=True).over(within) for x, (m, s) in since.items()})
    # one row a block; the last of its lines has what a mark has come to
    ends = [F.max_by(f"_at_{m}", "n").alias(f"_{m}") for m in (*marks, *since)] + [F.sum(f"_{s}").alias(f"_{s}") for s in sums] + [F.max_by(f"_{p}", "n").alias(f"_{p}") for p in previous]
    blocks = scanned.groupBy(*PLACE).agg(*ends)
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    if sums:
        blocks = blocks.withColumns({f"_from_{s}": F.coalesce(F.sum(f"_{s}").over(earlier), F.lit(0)) for s in sums})
    over = (
        [F.last(f"_{m}", ignorenulls=True).over(earlier).alias(f"_from_{m}") for m in marks]
        + [F.last(F.col(f"_{x}") + F.col(f"_from_{s}"), ignorenulls=True).over(earlier).alias(f"_from_{x}") for x, (_, s) in since.items()]
        + [F.lag(f"_{p}").over(Window.partitionBy("file").orderBy("block")).alias(f"_from_{p}") for p in previous]
    )
    joined = scanned.join(blocks.select(*PLACE, *(f"_from_{s}" for s in sums), *over), list(PLACE))
    total = lambda s: F.col(f"_at_{s}") + F.col(f"_from_{s}")
    return joined.select(
        *lines.columns,
        *(F.coalesce(f"_at_{m}", f"_from_{m}").alias(m) for m in marks),
        *(total(s).alias(s) for s in sums),
        *((total(s) - F.coalesce(F.col(f"_at_{x}") + F.col(f"_from_{s}"), F.col(f"_from_{x}"))).alias(x) for x, (_, s) in since.items()),
        *(F.when(F.col("_first"), F.col(f"_from_{p}")).otherwise(F.col(f"_at_{p}")).alias(p) for p in previous),
    )


def with_ordinal(df: DataFrame, name: str = "ord") -> DataFrame:
    """``df`` with dense row numbers from 0 in its own order: that of its partitions, and of the rows within them.

    One count a partition and a prefix sum over the counts; no row is moved. The rows must come out alike when they are read again.
    """
    marked = df.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33))
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(bases, "_part").select(*df.columns, (F.col("_base") + inner).alias(name))
