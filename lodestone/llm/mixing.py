"""Problem 6: mixing sources to target shares of the tokens, by balanced sampling.

A source that should give r times its tokens gives every document floor(r) times and a balanced sample of the rest, in which each
document has the inclusion probability r - floor(r). The cube method draws it: three documents at a time, their probabilities move
along the null space of the constraints (number and tokens), at random in either direction so that expectations hold, until one
of the three is in or out. Groups of a source fly on their own; what each leaves undecided (two documents at most) flies together,
and the last two of a source are landed on the combination that misses the totals least. Within a group the larger half flies first and the
smaller half makes up for what its last two documents miss, so that the landing is a matter of small documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.tokens import counted_tokens
from lodestone.operators.skew import skew_join
from lodestone.session import ensure_checkpoint_dir

#: Documents of a source that fly in one task.
FLIGHT = 100_000
#: Targets up to which the plan is broadcast, a row of four numbers each; beyond, it is joined by a shuffle.
MOST_TARGETS = 100_000
_EPS = 1e-9


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight phase: probabilities after moving, all but two at most 0 or 1. Sums of ``p`` and of ``p * size`` stay."""
    p = p.astype(float).copy()
    waiting = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    draws = rng.random(len(waiting) + 3)
    held: list[int] = []
    step = 0
    for i in waiting:
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[k]) / v if v > 0 else p[k] / -v for k, v in zip(held, u) if v)
        down = min(p[k] / v if v > 0 else (1 - p[k]) / -v for k, v in zip(held, u) if v)
        move = up if draws[step] * (up + down) < down else -down
        step += 1
        for k, v in zip(held, u):
            x = p[k] + move * v
            p[k] = 0.0 if x < _EPS else 1.0 if x > 1 - _EPS else x
        held = [k for k in held if 0 < p[k] < 1]
    return p


def fly_large_first(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Flight of documents in falling order of size, in two parts.

    The larger half flies and the two it leaves are drawn at random; by what this misses the expected tokens the probabilities of the
    smaller half are shifted, before it flies. So the expectation holds, and what is left to land is small.
    """
    half = len(p) - len(p) // 2 if len(p) >= 8 else 0
    if not half or not ((p > _EPS) & (p < 1 - _EPS)).any():
        return fly(p, size, rng)
    large = fly(p[:half], size[:half], rng)
    open_ = (large > 0) & (large < 1)
    large[open_] = rng.random(int(open_.sum())) < large[open_]
    missed = float(((p[:half] - large) * size[:half]).sum())
    rest = float(size[half:].sum())
    small = np.clip(p[half:] + (missed / rest if rest else 0.0), 0.0, 1.0)
    return np.concatenate([large, fly(small, size[half:], rng)])


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the few that are left so that tokens miss their expected total least, then the number."""
    at = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    best = min(product((0.0, 1.0), repeat=len(at)), key=lambda x: (abs(float(((np.array(x) - p[at]) * size[at]).sum())), abs(float((np.array(x) - p[at]).sum())), x), default=())
    p = p.copy()
    p[at] = best
    return p


def _with_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Adds the columns of a global aggregate, which is one row, to every row."""
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(one.withColumn("_one", F.lit(1))), "_one").drop("_one")


def source_plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of targets with what it needs and has: ``source, target_share, max_repeats, documents, available, wanted, ratio, capped``.

    ``wanted`` is the target share of the tokens of all documents, also those of other sources; ``ratio`` is how often the source
    must be used, ``capped`` at its ``max_repeats``. Sources compare trimmed in lower case; a null share or repeats count as 0.
    """
    have = documents.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("available"))
    total = have.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    rows = targets.select(F.col("source").alias("named"), F.lower(F.trim("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    joined = _with_one_row(rows.join(have, "source", "left"), total)
    available, wanted = F.coalesce("available", F.lit(0)), F.col("target_share") * F.col("total")
    capped = F.col("max_repeats") * available < wanted
    ratio = F.when(capped, F.col("max_repeats").cast("double")).when(available > 0, wanted / available).otherwise(F.lit(0.0))
    return joined.select("named", "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), available.alias("available"), wanted.alias("wanted"), ratio.alias("ratio"), capped.alias("capped"), "total")


def counted_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, source`` (trimmed, lower case, '' for null) and T01 ``tokens`` (0 for null texts), counted once and kept."""
    ensure_checkpoint_dir(documents.sparkSession)
    counted = documents.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("source"), F.coalesce(counted_tokens("text"), F.lit(0)).alias("tokens"))
    return counted.checkpoint()  # narrow rows, read by the plan, its total and the flights


def mixed(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, tokens, copies`` (one or more) of the mixture. The same seed gives the same mixture. Documents without id
    count in the totals but cannot be chosen.

    Each task flies one group of at most about ``FLIGHT`` documents. What the groups leave, two each, flies again in groups of
    that size, level by level, until a source has one group, which is landed.
    """
    return _mixed(counted_documents(documents), targets, seed)


def _mixed(docs: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    plan = source_plan(docs, targets).filter("source is not null and ratio > 0")
    use = plan.groupBy("source").agg(F.max("ratio").alias("ratio"), F.max("documents").alias("documents")).withColumn("groups", F.greatest(F.lit(1), F.ceil(F.col("documents") / F.lit(FLIGHT))))
    most, sources = use.agg(F.coalesce(F.max("groups"), F.lit(0)), F.count("*")).first()
    out = "source string, doc_id bigint, tokens bigint, copies int, p double"

    def with_use(df: DataFrame, *columns: str) -> DataFrame:
        few = use.select("source", *columns)
        return df.join(F.broadcast(few), "source") if sources <= MOST_TARGETS else skew_join(df, few, ["source"], "inner")

    def decide(way: Callable[..., np.ndarray], level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["tokens", "doc_id"], ascending=[False, True], kind="stable")
            p = way(g["p"].to_numpy(), g["tokens"].to_numpy(dtype=float), np.random.default_rng([seed, level, int(key[1]), *str(key[0]).encode()]))
            chosen = p > 1 - _EPS
            return pd.DataFrame({"source": g["source"], "doc_id": g["doc_id"], "tokens": g["tokens"], "copies": (g["copies"] + chosen).astype("int32"), "p": np.where(chosen, 0.0, p)})

        return run

    whole = F.floor(F.col("ratio") + _EPS)
    rows = with_use(docs.filter("doc_id is not null"), "ratio", "groups")
    open_ = rows.select("source", "doc_id", "tokens", whole.cast("int").alias("copies"), F.greatest(F.lit(0.0), F.col("ratio") - whole).alias("p"), "groups")
    done, level = [], 0
    while True:
        flight = open_.withColumn("flight", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.col("groups"))).select("source", "flight", "doc_id", "tokens", "copies", "p")
        # Narrow, and written so that each level flies once.
        flown = flight.groupBy("source", "flight").applyInPandas(decide(fly_large_first if not level else fly, level), out).checkpoint()
        done.append(flown.filter("p = 0"))
        left = flown.filter("p > 0")  # two a group at most
        if most <= 1:
            break
        level += 1
        most = -(-2 * most // FLIGHT)
        use = use.withColumn("groups", F.greatest(F.lit(1), F.ceil(2 * F.col("groups") / F.lit(FLIGHT))))
        open_ = with_use(left, "groups")
    landed = left.withColumn("flight", F.lit(0)).groupBy("source", "flight").applyInPandas(decide(lambda p, size, rng: land(p, size), level + 1), out)
    return reduce(DataFrame.unionByName, done, landed).filter("copies > 0").select("doc_id", "source", "tokens", "copies")


def mixture_report(documents: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """Each row of targets with its plan and the tokens that the mixture really has.

    ``short`` is read off the mixture: it uses every document of the source ``max_repeats`` times and still has fewer tokens than
    wanted. That agrees with ``capped``, the plan's own arithmetic, wherever all documents of a source have an id. ``missed_tokens``
    is what the landing missed of the lesser of what is wanted and what can be had. ``share_reached`` is of the mixture;
    ``share_of_all`` of the tokens of all documents, by which targets are set. The two differ where sources are capped, as the
    mixture is then smaller."""
    docs = counted_documents(documents)
    plan = source_plan(docs, targets)
    choosable = docs.filter("doc_id is not null").groupBy("source").agg(F.count("*").alias("choosable"))
    got = _mixed(docs, targets, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").cast("bigint").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("mixed_tokens").alias("mixture"))  # one row
    joined = _with_one_row(plan.join(got, "source", "left").join(choosable, "source", "left"), whole)
    mixed_tokens, mixed_documents = F.coalesce("mixed_tokens", F.lit(0)), F.coalesce("mixed_documents", F.lit(0))
    share = F.when(F.col("mixture") > 0, mixed_tokens / F.col("mixture")).otherwise(F.lit(0.0))
    used_up = mixed_documents >= F.col("max_repeats") * F.coalesce("choosable", F.lit(0))
    reachable = F.least(F.col("wanted"), (F.col("max_repeats") * F.col("available")).cast("double"))
    return joined.select(
        F.col("named").alias("source"), "target_share", "max_repeats", "documents", F.col("available").alias("available_tokens"), F.round("wanted", 3).alias("wanted_tokens"), "capped",
        (used_up & (mixed_tokens < F.col("wanted"))).alias("short"), mixed_tokens.alias("mixed_tokens"), F.round(mixed_tokens - reachable, 3).alias("missed_tokens"), mixed_documents.alias("mixed_documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.round(share, 6).alias("share_reached"),
        F.when(F.col("total") > 0, F.round(mixed_tokens / F.col("total"), 6)).otherwise(F.lit(0.0)).alias("share_of_all"),
    )
