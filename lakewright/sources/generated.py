"""Generated user rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Ages are whole numbers from 18 to 60, registration within a year.
MIN_AGE, MAX_AGE = 18, 60
YEAR_DAYS = 365


def generate_users(spark: SparkSession, n: int, seed: int, as_of: dt.datetime) -> DataFrame:
    """`n` users: user_1 ..., a random age and a registration time in the year before `as_of`."""
    age = F.floor(F.rand(seed) * (MAX_AGE - MIN_AGE + 1) + MIN_AGE).cast("int")
    back = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.rand(seed + 1) * (YEAR_DAYS * 86400)).cast("decimal(18,6)"))
    return spark.range(1, n + 1).select(
        F.concat(F.lit("user_"), F.col("id").cast("string")).alias("username"),
        age.alias("age"),
        (F.lit(as_of).cast("timestamp") - back).alias("registered_at"),
    )
