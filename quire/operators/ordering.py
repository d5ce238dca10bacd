"""Rows by their place in an order, without a window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import free_name
from quire.sources.io import new_folder

#: Parts that rows of one value can be dealt to.
SALTS = 1024


def numbered(df: DataFrame, order: Sequence[str], number: str) -> DataFrame:
    """``df`` with ``number``: each row's place from 0 in the order of the columns ``order``, nulls first.

    Rows are dealt to ranges and written to the shared folder with their place in the range, so that a task that is run again finds the
    same; only the ranges' counts, one for each task, come together and move the places on. Rows of one value may be in several
    ranges and have any order among them. A column called ``number`` is replaced.
    """
    spark = df.sparkSession
    df = df.drop(number)
    salt, place = free_name(df.columns, "salt"), free_name(df.columns, "place")
    dealt = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    # the id holds the range in its upper and the place within in its lower 33 bits
    ranged = dealt.repartitionByRange(*order, salt).sortWithinPartitions(*order, salt).drop(salt).withColumn(place, F.monotonically_increasing_id())
    path = new_folder(spark, "ordinals")
    ranged.write.parquet(path)
    held = spark.read.schema(ranged.schema).parquet(path).withColumn("__range", F.shiftright(place, 33))
    before, total = [], 0
    for r in held.groupBy("__range").count().orderBy("__range").collect():
        before.append((r["__range"], total))
        total += r["count"]
    start = spark.createDataFrame(before or [(0, 0)], "__range long, __before long")
    at = F.col("__before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    return held.join(F.broadcast(start), "__range").withColumn(number, at).select(*df.columns, number)


def zip_by_order(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Positional join: row n of one side with row n of the other; the longer side's further rows go."""
    name = free_name([*left.columns, *right.columns], "n")
    return numbered(left, [left_order], name).join(numbered(right, [right_order], name), name).drop(name)
