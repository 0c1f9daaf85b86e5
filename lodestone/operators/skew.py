"""A join whose frequent keys are spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that one task may join.
ROWS = 1_000_000


def salted(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``: rows of ``left`` with one key are spread over as many salts as they have ``ROWS``, and each row of
    ``right`` is there once for every salt of its key.

    The rows of ``left`` are counted by key, on the map side first and as a part of the same plan, so nothing runs while it is built. Of n
    rows, at most n / ``ROWS`` keys can be that frequent, and only these are broadcast. The salt is a hash of the other columns, so rows
    that are copies of each other stay together.
    """
    spread = {c: f"_k{i}" for i, c in enumerate(keys)}
    counts = left.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > ROWS)
    hot = F.broadcast(counts.select(*[F.col(c).alias(n) for c, n in spread.items()], F.ceil(F.col("_n") / F.lit(ROWS)).alias("_salts")))

    def salts(df: DataFrame) -> DataFrame:
        on = [df[c].eqNullSafe(F.col(n)) for c, n in spread.items()]
        return df.join(hot, on, "left").drop(*spread.values()).withColumn("_salts", F.coalesce("_salts", F.lit(1).cast("bigint")))

    others = [c for c in left.columns if c not in keys]
    one = salts(left).withColumn("_salt", F.pmod(F.xxhash64(*(others or keys)), F.col("_salts"))).drop("_salts")
    return one, salts(right).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_salts") - 1))).drop("_salts")


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined (``left`` or ``inner``) with ``right``, which has at most a few rows a key, on ``keys``.

    Adaptive execution splits a frequent key only where both sides come straight from a shuffle, which a grouped side does not; here
    both are ``salted``. Null keys match nothing and are spread too.
    """
    one, copies = salted(left, right, keys)
    return one.join(copies, [*keys, "_salt"], how).drop("_salt")
