"""Keeping an index current (J11, J12, A08, S17, S19, ST1) on Parquet folders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.current import current_files
from lodestone.operators.extract import extract
from lodestone.operators.store import BucketStore
from lodestone.schema import FILES, SYMBOL_REFS, SYMBOLS
from lodestone.session import ensure_checkpoint_dir


def diff(previous: DataFrame, scanned: DataFrame) -> DataFrame:
    """Every path of either side with its status: unchanged, changed, added or removed. Only hashes travel."""
    a = previous.select("path", F.coalesce("sha256", F.lit("")).alias("_old"))
    b = scanned.select("path", F.coalesce("sha256", F.lit("")).alias("_new"))
    status = F.when(F.col("_new").isNull(), "removed").when(F.col("_old").isNull(), "added").when(F.col("_old") == F.col("_new"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def run_counters(changes: DataFrame) -> DataFrame:
    """One row: updated, skipped and removed files of a run."""
    n = lambda *s: F.sum(F.when(F.col("status").isin(*s), 1).otherwise(0)).cast("bigint")
    return changes.agg(F.coalesce(n("added", "changed"), F.lit(0)).alias("updated"), F.coalesce(n("unchanged"), F.lit(0)).alias("skipped"), F.coalesce(n("removed"), F.lit(0)).alias("removed"))


def stale(table: DataFrame, scanned: DataFrame) -> DataFrame:
    """Rows of paths that were not scanned, which are to go from every table."""
    return table.join(scanned.select("path").distinct(), "path", "left_anti")


def store_of(spark: SparkSession, root: str) -> BucketStore:
    return BucketStore(spark, root, "path", {"files": FILES, "symbols": SYMBOLS, "symbol_refs": SYMBOL_REFS})


def update_index(spark: SparkSession, root: str, scanned: DataFrame, clean: bool = False, notify: Callable[[str, dict], None] | None = None) -> DataFrame:
    """One run: unchanged files keep their rows, changed and new ones are extracted again, others go. Gives the counters.

    Only buckets with a path that is new, changed or gone are read and written. All three tables of a run are named by one rename, so that
    a run that fails leaves the index as it was. ``notify`` (ST2) hears of start, progress (paths by status), finish and error.
    """
    tell = notify or (lambda event, what: None)
    tell("start", {})
    try:
        ensure_checkpoint_dir(spark)
        store = store_of(spark, root)
        if clean:
            store.clear()
        scanned = scanned.dropDuplicates(["path"])
        changes = diff(store.read("files"), scanned).checkpoint()  # paths, read several times
        counters = run_counters(changes)
        rows = counters.collect()
        tell("progress", rows[0].asDict())
        touched = store.touched(changes.filter("status <> 'unchanged'"))
        if touched or store.state() is None:
            same = changes.filter("status = 'unchanged'").select("path")
            fresh = scanned.join(changes.filter("status in ('added', 'changed')").select("path"), "path", "left_semi")
            symbols, refs = extract(fresh)
            kept = lambda t: store.read(t, touched).join(same, "path", "left_semi")
            frames = {"files": fresh.select(*FILES.names), "symbols": symbols, "symbol_refs": refs}
            version = store.replace({t: kept(t).unionByName(df.select(*kept(t).columns)) for t, df in frames.items()}, touched)
            tell("finish", {"version": version, "buckets": len(touched)})
        else:
            tell("finish", {"version": store.state()["version"], "buckets": 0})
        return spark.createDataFrame(rows, counters.schema)
    except Exception as e:
        tell("error", {"message": str(e)})
        raise


def read_index(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the current version."""
    store = store_of(spark, root)
    if store.state() is None:
        raise FileNotFoundError(f"no index at {root}")
    return {t: store.read(t) for t in store.schemas}


def snapshot(files: DataFrame, until: str) -> DataFrame:
    """The index as it stood at a time: the current rows among those indexed by then."""
    return current_files(files.filter(F.col("indexed_at") <= F.lit(until).cast("timestamp_ntz")), ["path", "sha256"])
