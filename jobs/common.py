"""What the jobs share: config files, tables that may have no rows yet, the command line's session."""

from __future__ import annotations

import json
import logging
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("quire.jobs")


def settings(defaults: Mapping[str, object], given: Mapping[str, object]) -> dict[str, object]:
    """``defaults`` with ``given`` over them; an unknown name or a value of another type is an error."""
    for name, value in given.items():
        if name not in defaults:
            raise ValueError(f"unknown setting {name}; known are {', '.join(sorted(defaults))}")
        if isinstance(value, bool) != isinstance(defaults[name], bool) or not isinstance(value, (type(defaults[name]), int)):
            raise ValueError(f"setting {name} must be like {defaults[name]!r}")
    return {**defaults, **given}


def read_config(spark: SparkSession, path: str) -> dict[str, object]:
    """A JSON object of settings, from any store that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def open_table(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """See to it that ``path`` can be read before its first rows are written: an append of no rows."""
    spark.createDataFrame([], schema).write.mode("append").partitionBy(*by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` in place of the partitions that it has rows for, so that a repeated write changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def part_of(column: str) -> F.Column:
    """A value that can name a folder: null and the empty text are ``none``."""
    c = F.col(column).cast("string")
    return F.when(F.coalesce(c, F.lit("")) == "", "none").otherwise(c)


def session(name: str) -> SparkSession:
    """The command line's session; master and resources come from spark-submit or spark-defaults."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC").getOrCreate()
