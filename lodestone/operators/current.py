"""Latest row of a key, the view that every query on ``files`` and ``actions`` starts from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order`` values, nulls lowest; exact ties give the same row.

    Aggregated on the map side, so many versions of one key never meet in one task. Rows with a null key form a key of
    their own. Only ``columns`` (all by default) travel.
    """
    columns = columns or df.columns
    rest = [c for c in columns if c not in keys]
    rank: Column = F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order and c != "content"]] if dict(df.dtypes)[c] != "map"])
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def current_files(files: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The current row of each path: latest ``indexed_at``, ties by hash. Paths that are null are dropped."""
    columns = columns or ["path", "language", "sha256", "content"]
    wanted = [*dict.fromkeys(["path", *columns])]
    need = files.select(*dict.fromkeys([*wanted, "indexed_at", "sha256"])).filter(F.col("path").isNotNull())
    rest = [c for c in wanted if c != "path"]
    picked = need.groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("indexed_at", "sha256")).alias("_row"))
    return picked.select("path", *[F.col(f"_row.{c}").alias(c) for c in rest])


def repository_of(path: Column | str) -> Column:
    """First part of a path."""
    return F.split_part(F.col(path) if isinstance(path, str) else path, F.lit("/"), F.lit(1))


def among_current(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Those of some rows of ``files`` (with ``path, indexed_at, sha256``) that are current, each path once.

    For rows that a filter has already thinned out: the current rows are told by their narrow keys, so that contents that
    the filter dropped never travel.
    """
    keys = files.filter("path is not null").groupBy("path").agg(F.max(F.struct("indexed_at", "sha256")).alias("_key"))
    k = keys.select(F.col("path").alias("_path"), F.col("_key.indexed_at").alias("_at"), F.col("_key.sha256").alias("_sha"))
    held = rows.join(k, (F.col("path") == F.col("_path")) & F.col("indexed_at").eqNullSafe(F.col("_at")) & F.col("sha256").eqNullSafe(F.col("_sha")), "left_semi")
    rest = [c for c in rows.columns if c != "path"]
    one = held.groupBy("path").agg(F.first(F.struct(*rest)).alias("_row"))  # rows of one key are copies
    return one.select("path", *[F.col(f"_row.{c}").alias(c) for c in rest])
