"""Similarity links (J10), topics, folder graphs and their merger."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import VECTOR_SIZE
from lodestone.session import ensure_checkpoint_dir

#: Queries and items that meet in one task: 4096 x 128 floats are 2 MB, and their similarities 128 MB.
BLOCK, CHUNK = 4096, 4096
_MEETINGS = 1 << 22


def proxy_vectors(texts: pd.Series, form: type = np.float64) -> np.ndarray:
    """One row of hashed word counts a text; as 64-bit numbers of length 1 (or 0 for a text without words), else as counts."""
    bucket: dict[str, int] = {}
    out = np.zeros((len(texts), VECTOR_SIZE), dtype=form)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            b = bucket.get(w)
            if b is None:
                b = bucket[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % VECTOR_SIZE
            out[i, b] += 1
    if form is not np.float64:
        return out
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def _grid(items: DataFrame, queries: DataFrame, meet: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """Every block of queries meets every chunk of items (both ``id, vec``) in a task of its own, and what ``meet`` makes of them comes out.

    Rows go to blocks and chunks by a hash of their id, so no side is collected or broadcast; only the two counts leave the
    cluster. A vector travels once for each block, or chunk, of the other side.
    """
    n, m = queries.count(), items.count()
    blocks, chunks = max(1, -(-5 * n // (4 * BLOCK))), max(1, -(-5 * m // (4 * CHUNK)))

    def cells(df: DataFrame, own: str, k: int, other: str, others: int) -> DataFrame:
        return df.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(k)).alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    left = cells(queries, "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    right = cells(items, "chunk", chunks, "block", blocks).select("id", "vec", "block", "chunk").groupBy("block", "chunk")

    def cell(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c.split()[0]: pd.Series(dtype="float64") for c in schema.split(", ")})
        if not len(q) or not len(x):
            return empty
        unit = lambda v: (a := np.array(v.tolist(), dtype=np.float64)) / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
        q, x = q.sort_values("id"), x.sort_values("id")
        ids, names, vectors, all_ = q["id"].to_numpy(), x["id"].to_numpy(), unit(q["vec"]), unit(x["vec"])
        step = max(1, _MEETINGS // len(names))
        parts = []
        for i in range(0, len(ids), step):
            s = np.round(vectors[i : i + step] @ all_.T, 6)
            s[ids[i : i + step, None] == names[None, :]] = -2.0
            parts.append(meet(ids[i : i + step], names, s))
        return pd.concat(parts) if parts else empty

    return left.cogroup(right).applyInPandas(cell, schema)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def _vectors(texts: pd.Series) -> pd.Series:
    return pd.Series(list(proxy_vectors(texts, np.float32)))


def link_counts(items: DataFrame, queries: DataFrame, key: str, text: str, threshold: float = 0.3) -> DataFrame:
    """J10 as a search: for each query its number of links (similarity at the threshold or above) to other items and the closest one.

    ``source, links, target, strength``. Queries are a stated set; every block of them meets every chunk of the items, and only a count
    and a best item a query leave a task. Vectors are made once a row, of whole numbers, so that they lose nothing as floats. Null
    texts have no links; rows without key are left out.
    """

    def vectors(df: DataFrame) -> DataFrame:
        return df.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), _vectors(text).alias("vec"))

    def meet(ids: np.ndarray, names: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        top = s.argmax(axis=1)  # items are in order, so the first of equals has the lowest key
        return pd.DataFrame({"source": ids, "links": (s >= threshold).sum(axis=1), "target": names[top], "strength": s[np.arange(len(ids)), top]})

    out = _grid(vectors(items), vectors(queries), meet, "source bigint, links bigint, target bigint, strength double")
    rank = F.struct("strength", (-F.col("target")).alias("t"))
    merged = out.groupBy("source").agg(F.sum("links").alias("links"), F.max(F.when(F.col("strength") >= threshold, rank)).alias("r"))
    return merged.select("source", "links", (-F.col("r.t")).alias("target"), F.col("r.strength").alias("strength"))


def nearest_vectors(items: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """K04 on stored vectors: the ``k`` items of greatest cosine to each query, itself excepted: ``query, rank, item, score``.

    Exact. Every block of queries meets every chunk of items, a task keeps k items a query, and ties go to the lower id. Vectors meet those
    of their own length; null and empty ones meet none.
    """
    from pyspark.sql import Window

    rows = lambda df: df.filter(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).alias("id"), F.col(vector).alias("vec"))
    items, queries = rows(items), rows(queries)

    def meet(ids: np.ndarray, names: np.ndarray, s: np.ndarray) -> pd.DataFrame:
        order = np.argsort(-s, axis=1, kind="stable")[:, :k] if s.shape[1] <= 4 * k else _best(s, k)
        score = np.take_along_axis(s, order, axis=1)
        part = pd.DataFrame({"query": np.repeat(ids, order.shape[1]), "item": names[order].ravel(), "score": score.ravel()})
        return part[part["score"] > -2.0]

    w = Window.partitionBy("query").orderBy(F.desc("score"), "item")
    out = None
    for size in sorted(r[0] for r in queries.select(F.size("vec")).distinct().collect()):  # lengths of vectors, a few
        part = _grid(items.filter(F.size("vec") == size), queries.filter(F.size("vec") == size), meet, "query bigint, item bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return items.sparkSession.createDataFrame([], "query bigint, rank int, item bigint, score double")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query", "rank", "item", "score")


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest entries of each row, first ones first among equals."""
    least = -np.partition(-s, k - 1, axis=1)[:, k - 1 : k]
    weight = np.where(s > least, 2, np.where(s == least, 1, 0))
    near = np.argsort(-weight, axis=1, kind="stable")[:, :k]
    near.sort(axis=1)
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, axis=1), axis=1, kind="stable"), axis=1)


def folder_edges(paths: DataFrame) -> DataFrame:
    """Every folder and file with its parent, ``Project`` above all: ``child, parent, grp`` (folder or file), each edge once."""
    parts = F.split("path", "/")
    n = F.size(parts)
    prefix = lambda i: F.array_join(F.slice(parts, 1, i), "/")
    edge = lambda i: F.struct(prefix(i).alias("child"), F.when(i == 1, F.lit("Project")).otherwise(prefix(F.greatest(F.lit(1), i - 1))).alias("parent"), F.when(i == n, "file").otherwise("folder").alias("grp"))
    return paths.filter("path is not null").select(F.explode(F.transform(F.sequence(F.lit(1), n), edge)).alias("e")).select("e.*").distinct()


def undirected_links(links: DataFrame) -> DataFrame:
    """Links without direction: each unordered pair once with its greatest strength, null strengths as 0, loops left out."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    return links.filter("source is not null and target is not null and source <> target").groupBy(a.alias("source"), b.alias("target")).agg(F.coalesce(F.max("strength"), F.lit(0.0)).alias("strength"))


def merged_graph(tree: DataFrame, links: DataFrame, topics: DataFrame) -> DataFrame:
    """Tree and similarity edges with the topic of their source, ``General`` by default: ``source, target, relation, strength, topic``."""
    t = tree.select(F.col("parent").alias("source"), F.col("child").alias("target"), F.lit("tree").alias("relation"), F.lit(1.0).alias("strength"))
    s = links.select("source", "target", F.lit("semantic").alias("relation"), "strength")
    return t.unionByName(s).join(topics.select(F.col("path").alias("source"), "topic"), "source", "left").withColumn("topic", F.coalesce("topic", F.lit("General")))


def tree_order(edges: DataFrame) -> DataFrame:
    """Each child with its place among its siblings: folders first, then names: ``parent, place, child, grp``.

    Edges are laid out in order over ranges; a place is counted within its range and moved by what the parent has in earlier ones, so
    the children of one parent need not fit a task. The ranges are written, so that both readings see the same ones.
    """
    from pyspark.sql import Window

    ensure_checkpoint_dir(edges.sparkSession)
    order = F.when(F.col("grp") == "folder", 0).otherwise(1).alias("ord")
    laid = edges.select("parent", "child", "grp", order).repartitionByRange("parent", "ord", "child").withColumn("part", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy("parent").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("parent", "part").agg(F.count("*").alias("n"))
    moved = sizes.select("parent", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("parent", "part").orderBy("ord", "child"))
    return laid.withColumn("here", here).join(moved, ["parent", "part"]).select("parent", (F.col("here") + F.col("before")).cast("int").alias("place"), "child", "grp")
