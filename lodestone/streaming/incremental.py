"""Streams: the current files as they arrive (ST1, ST2), the last state of actions (ST4), and, as an extension, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.current import current_files
from lodestone.operators.stats import latest_actions
from lodestone.operators.store import BucketStore
from lodestone.schema import ACTIONS, FILES
from lodestone.session import ensure_checkpoint_dir


Notify = Callable[[str, int], None]


def state_store(spark: SparkSession, root: str, kind: str) -> BucketStore:
    """The state that a stream of ``files`` or ``actions`` keeps."""
    key, schema = {"files": ("path", FILES), "actions": ("id", ACTIONS)}[kind]
    return BucketStore(spark, root, key, {kind: schema})


def read_state(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The current rows after the last batch that was merged."""
    return state_store(spark, root, kind).read(kind)


def _merge(root: str, kind: str, latest: Callable[[DataFrame], DataFrame], notify: Notify | None) -> Callable[[DataFrame, int], None]:
    """Merges a micro-batch into the state: only buckets that the batch has keys of are read and written.

    The state knows the number of its last batch, so a batch that is repeated after a failure changes nothing, and one that does not follow
    on the state (as when its folder was lost) is refused. ``notify`` hears of start, progress, finish and error with the batch's number.
    """
    tell = notify or (lambda event, number: None)

    def merge(batch: DataFrame, number: int) -> None:
        tell("start", number)
        try:
            store = state_store(batch.sparkSession, root, kind)
            state = store.state()
            last = state["batch"] if state else -1
            if number > last:
                if number != last + 1:
                    raise RuntimeError(f"batch {number} does not follow on the state at {root}, whose last is {last}")
                ensure_checkpoint_dir(batch.sparkSession)
                news = latest(batch).checkpoint()  # one row a key, read twice
                touched = store.touched(news)
                tell("progress", number)
                store.replace({kind: latest(store.read(kind, touched).unionByName(news))}, touched, number)
            tell("finish", number)
        except Exception:
            tell("error", number)
            raise

    return merge


def _start(spark: SparkSession, source: str, schema: T.StructType, kind: str, latest: Callable[[DataFrame], DataFrame], store: str, checkpoint: str, notify: Notify | None) -> StreamingQuery:
    read = spark.readStream.schema(schema).parquet(source)
    return read.writeStream.foreachBatch(_merge(store, kind, latest, notify)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_files(spark: SparkSession, source: str, store: str, checkpoint: str, notify: Notify | None = None) -> StreamingQuery:
    """ST1: rows of ``files`` arriving as Parquet; after each batch the state holds the current row of every path."""
    return _start(spark, source, FILES, "files", lambda df: current_files(df, FILES.names).select(*FILES.names), store, checkpoint, notify)


def stream_actions(spark: SparkSession, source: str, store: str, checkpoint: str, notify: Notify | None = None) -> StreamingQuery:
    """ST4: the last state of each action after every batch; late pending rows do not undo a final one of a later time."""
    return _start(spark, source, ACTIONS, "actions", lambda df: latest_actions(df).select(*ACTIONS.names), store, checkpoint, notify)


def event_windows(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: tumbling counts and sums by type. ``ts`` without zone is read as UTC, as watermarks need an instant."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = stamped.withWatermark("ts", late) if stamped.isStreaming else stamped
    out = marked.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events", "value")
