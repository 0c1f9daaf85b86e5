"""Problem 5: filling containers of fixed capacity.

Only the number of items of each size matters, at most ``capacity`` numbers whatever the corpus holds. From them the driver plans
containers by minimum bin slack: the largest size left is set, a bitset subset-sum over the sizes left (with their counts) finds the
total nearest to the capacity, backtracking gives the multiset, and the pattern is used as often as the counts allow. Items then find
their container by their rank among those of their size, which is counted in salted groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.tokens import measure
from lodestone.llm.splitting import split_text
from lodestone.session import ensure_checkpoint_dir

#: Items of one size that one task ranks.
RANKED = 200_000


def _closest(room: int, sizes: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of sizes, within their counts, whose sum is nearest to ``room`` from below.

    Bit i of the set is on if i can be reached; each step adds 1, 2, 4, ... copies of a size. Larger sizes come first, and the
    search ends as soon as the room can be filled exactly.
    """
    mask = (1 << (room + 1)) - 1
    reach = 1
    steps: list[tuple[int, int, int]] = []
    for size in sizes:
        left = min(counts[size], room // size) if size <= room else 0
        copies = 1
        while left > 0:
            use = min(copies, left)
            before = reach
            reach |= (reach << (size * use)) & mask
            if reach != before:
                steps.append((size, use, before))
            left -= use
            copies *= 2
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    out: dict[int, int] = {}
    for size, use, before in reversed(steps):
        if not before >> total & 1:
            out[size] = out.get(size, 0) + use
            total -= size * use
    return out


def plan_containers(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (copies of each size) and how many containers each fills; every item of sizes 1..capacity is in one."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    if any(s < 1 or s > capacity for s in counts):
        raise ValueError("sizes must lie in 1..capacity")
    out = []
    while counts:
        sizes = sorted(counts, reverse=True)
        seed = sizes[0]
        counts[seed] -= 1
        pattern = _closest(capacity - seed, [s for s in sizes if counts[s] > 0], counts)
        counts[seed] += 1
        pattern[seed] = pattern.get(seed, 0) + 1
        times = min(counts[s] // c for s, c in pattern.items())
        out.append((pattern, times))
        for s, c in pattern.items():
            counts[s] -= c * times
            if not counts[s]:
                del counts[s]
    return out


def _segments(plan: list[tuple[dict[int, int], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size: first ranks of its stretches, copies a container, first container."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    at = 0
    for pattern, times in plan:
        for size, copies in pattern.items():
            rows.setdefault(size, []).append((used.get(size, 0), copies, at))
            used[size] = used.get(size, 0) + copies * times
        at += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r)) for s, r in rows.items()}


def container_items(documents: DataFrame, capacity: int) -> DataFrame:
    """What is packed: ``doc_id, piece, pieces, tokens``; one row a document, more for those larger than a container, which the splitter
    cuts without overlap. Null texts have no tokens."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].fillna("").tolist()
            sizes = measure(texts)[:, 0]
            ids, rows = [], []
            for i in np.flatnonzero(sizes > capacity):
                pieces = split_text(texts[i], capacity)
                ids.append(np.repeat(i, len(pieces)))
                rows += [(p, len(pieces), t) for p, (_, _, t) in enumerate(pieces)]
            whole = np.flatnonzero(sizes <= capacity)
            out = pd.DataFrame({"piece": 0, "pieces": 1, "tokens": sizes[whole]}, dtype="int32")
            if rows:
                out = pd.concat([out, pd.DataFrame(rows, columns=["piece", "pieces", "tokens"], dtype="int32")])
            chosen = np.concatenate([whole, *ids])
            out.insert(0, "doc_id", b["doc_id"].iloc[chosen].to_numpy())
            yield out

    # As text on the way, since pandas would make floats of integers beside nulls.
    schema = T.StructType([T.StructField("doc_id", T.StringType()), *[T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "tokens")]])
    counted = documents.select(F.col("doc_id").cast("string"), "text").mapInPandas(count, schema)
    return counted.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def packed(documents: DataFrame, capacity: int) -> DataFrame:
    """``container, doc_id, piece, pieces, tokens``: every document, whole or in pieces, in one container each.

    Rows whose ``doc_id`` repeats are items of their own. Documents without tokens are spread over the containers; where these
    are few, further containers take them, so that none holds more than ``capacity`` of them.
    """
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    items = container_items(documents, capacity).checkpoint()  # narrow rows; read twice below
    histogram = {r.tokens: r.n for r in items.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    empty = histogram.pop(0, 0)
    plan = plan_containers(histogram, capacity)
    segments = _segments(plan)
    containers = max(1, sum(n for _, n in plan), -(-empty // capacity))
    groups = {s: -(-n // RANKED) for s, n in (histogram | {0: empty}).items() if n > RANKED}
    salts = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in groups.items() for x in kv]), F.col("tokens")), F.lit(1)) if groups else F.lit(1)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), salts))
    ranked = salted.withColumn("nth", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("doc_id", "piece")) - 1)
    sizes = salted.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    @F.pandas_udf("bigint")
    def container(tokens: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(tokens), dtype=np.int64)
        t, r = tokens.to_numpy(), rank.to_numpy()
        for size in np.unique(t):
            at = t == size
            if size == 0:
                out[at] = r[at] % containers
            else:
                first, copies, start = segments[int(size)]
                k = np.searchsorted(first, r[at], side="right") - 1
                out[at] = start[k] + (r[at] - first[k]) // copies[k]
        return pd.Series(out)

    placed = ranked.join(offsets, ["tokens", "salt"])
    return placed.select(container("tokens", F.col("nth") + F.col("before")).alias("container"), "doc_id", "piece", "pieces", "tokens")


def containers(documents: DataFrame, capacity: int) -> DataFrame:
    """Each container's ``contents``, ``used`` and ``unused`` tokens. A container holds at most ``capacity`` items with tokens."""
    item = F.struct("doc_id", "piece", "pieces", "tokens")
    return packed(documents, capacity).groupBy("container").agg(F.sort_array(F.collect_list(item)).alias("contents"), F.sum("tokens").cast("bigint").alias("used"), F.count("*").alias("items")).withColumn("unused", F.lit(capacity) - F.col("used"))


def split_documents(boxes: DataFrame) -> DataFrame:
    """The ``doc_id`` of every document that the containers hold in pieces, read off their contents, once each."""
    held = boxes.select(F.explode(F.filter("contents", lambda x: (x["pieces"] > 1) & (x["piece"] == 0))).alias("x"))
    return held.select("x.doc_id").distinct()
