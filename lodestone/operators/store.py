"""Tables in buckets by a key, of which a run rewrites only those that it touches (S17, S19, ST1)."""

from __future__ import annotations

import json
from collections.abc import Iterable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a new store; a store keeps the number that it was made with.
BUCKETS = 64
#: States before the present one whose files stay for readers that began with them.
KEPT = 1


class BucketStore:
    """Tables that share a key column. Each bucket of each table lies in the folder of the version that wrote it last; the file CURRENT names
    these versions and takes the place of the one before by one rename. A run that fails, or that is repeated, leaves the tables as they
    were; what no kept state names is removed. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, schemas: dict[str, T.StructType], buckets: int = BUCKETS):
        self.spark, self.root, self.key, self.schemas, self._buckets = spark, root, key, schemas, buckets

    # ------------------------------------------------------------------------------------------------------ the manifest
    def _path(self, name: str):
        jvm = self.spark._jvm
        return jvm, jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), self.spark._jsc.hadoopConfiguration()

    def state(self) -> dict | None:
        """What CURRENT says, or None: ``version``, ``batch``, ``buckets`` and, for each table, the version of each of its buckets."""
        _, path, conf = self._path("CURRENT")
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _name(self, state: dict) -> None:
        beside = f".CURRENT-{uuid4().hex}"
        jvm, new, conf = self._path(beside)
        stream = new.getFileSystem(conf).create(new, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        _, current, _ = self._path("CURRENT")
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), conf).rename(new, current, options)

    # --------------------------------------------------------------------------------------------------------- tables
    def bucket(self, key: str | None = None) -> Column:
        state = self.state()
        return F.pmod(F.xxhash64(key or self.key), F.lit(state["buckets"] if state else self._buckets)).cast("int")

    def read(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or those of its buckets that are asked for; a store that does not exist has empty ones."""
        state = self.state()
        held = state["tables"].get(table, {}) if state else {}
        wanted = None if buckets is None else set(buckets)
        places = [f"{self.root}/v{v}/{table}/_b={b}" for b, v in sorted(held.items(), key=lambda x: int(x[0])) if wanted is None or int(b) in wanted]
        schema = self.schemas[table]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame, key: str | None = None) -> list[int]:
        """The buckets of some keys: as many numbers as the store has buckets at most."""
        return sorted(r[0] for r in keys.select(self.bucket(key).alias("b")).distinct().collect())

    def replace(self, frames: dict[str, DataFrame], touched: list[int], batch: int = -1) -> int:
        """Writes the rows of the touched buckets, given whole, as a new version and names it. Gives the version."""
        state = self.state() or {"version": 0, "batch": -1, "buckets": self._buckets, "tables": {}, "before": []}
        version = state["version"] + 1
        tables = {t: dict(v) for t, v in state["tables"].items()}
        for name, df in frames.items():
            columns = self.schemas[name].names
            place = f"{self.root}/v{version}/{name}"
            # Large buckets are split over tasks, small ones share one.
            df.select(*columns, self.bucket().alias("_b")).hint("rebalance", "_b").write.mode("overwrite").partitionBy("_b").parquet(place)
            written = {str(b): version for b in self._written(place)}
            rest = {b: v for b, v in tables.get(name, {}).items() if int(b) not in set(touched)}
            tables[name] = rest | written
        before = [*state["before"], self._versions(state["tables"])][-KEPT:] if state["version"] else []
        self._name({"version": version, "batch": batch, "buckets": state["buckets"], "tables": tables, "before": before})
        self._remove({v for held in before for v in held} | set(self._versions(tables)) | {version})
        return version

    def clear(self) -> None:
        """Forgets every table; the files go as soon as another version is named."""
        state = self.state()
        if state is not None:
            self._name(state | {"tables": {}, "before": []})

    @staticmethod
    def _versions(tables: dict) -> list[int]:
        return sorted({v for held in tables.values() for v in held.values()})

    def _written(self, place: str) -> list[int]:
        _, path, conf = self._path(place.removeprefix(f"{self.root}/"))
        return [int(s.getPath().getName()[3:]) for s in path.getFileSystem(conf).listStatus(path) if s.getPath().getName().startswith("_b=")]

    def _remove(self, kept: set[int]) -> None:
        _, path, conf = self._path("")
        fs = path.getFileSystem(conf)
        for s in fs.listStatus(path):
            name = s.getPath().getName()
            if s.isDirectory() and name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in kept:
                fs.delete(s.getPath(), True)
