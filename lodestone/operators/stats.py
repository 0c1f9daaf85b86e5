"""Aggregates and ordered lists of the index (A01-A12, K01-K09, ST4) and the project report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import extension, topic_words
from lodestone.functions.tokens import token_estimate
from lodestone.operators.symbols import top_referenced


def repo_stats(files: DataFrame, symbols: DataFrame, prefix: str = "") -> DataFrame:
    """One row of counts and sums over the files (and their symbols) below a prefix; nulls count 0."""
    f = files.filter(F.col("path").startswith(prefix))
    s = symbols.filter(F.col("path").startswith(prefix))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    left = f.agg(F.count("*").alias("files"), total("size_bytes"), total("doc_lines"), total("code_lines"))
    right = s.agg(F.count("*").alias("symbols"))
    return left.withColumn("_one", F.lit(1)).join(F.broadcast(right.withColumn("_one", F.lit(1))), "_one").drop("_one")


def kind_histogram(symbols: DataFrame, top: int | None = None) -> DataFrame:
    """Symbols by kind; with ``top`` only the most frequent, ties by kind."""
    counts = symbols.groupBy("kind").agg(F.count("*").alias("n"))
    return counts if top is None else counts.orderBy(F.desc("n"), "kind").limit(top)


def naive_tokens(files: DataFrame, ext: str = "swift") -> DataFrame:
    """Files of one extension and the tokens of all their text."""
    chosen = files.filter(extension("path") == ext)
    return chosen.agg(F.count("*").alias("files"), F.coalesce(F.sum(token_estimate(F.coalesce("content", F.lit("")))), F.lit(0)).cast("bigint").alias("tokens"))


def latest_actions(actions: DataFrame) -> DataFrame:
    """ST4: the last state of each action: latest ``ts``; at the same time completed and failed go before pending."""
    rest = [c for c in actions.columns if c != "id"]
    rank = F.struct("ts", (F.coalesce("status", F.lit("")) != "pending").cast("int"), *[F.col(c) for c in sorted(rest) if c not in ("ts",)])
    return actions.groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])


def recent_actions(actions: DataFrame, limit: int = 50) -> DataFrame:
    """Last actions, newest first; nulls last, ties by id."""
    return latest_actions(actions).orderBy(F.desc_nulls_last("ts"), "id").limit(limit)


def action_costs(actions: DataFrame) -> DataFrame:
    """By tool, final actions with their recorded tokens, T01 of prompt and response, and duration."""
    spent = token_estimate(F.concat(F.lit("prompt: "), F.coalesce("prompt", F.lit("")))) + F.coalesce(token_estimate("response"), F.lit(0))
    a = latest_actions(actions).select(F.coalesce("tool_name", F.lit("")).alias("tool"), "status", "tokens_used", "duration_ms", spent.alias("spent"))
    total = lambda c, n: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n)
    return a.groupBy("tool", "status").agg(F.count("*").alias("actions"), total("tokens_used", "recorded_tokens"), total("spent", "estimated_tokens"), total("duration_ms", "duration_ms"))


def recent_files(files: DataFrame, limit: int = 10) -> DataFrame:
    """Files by modification, newest first, nulls last, ties by path."""
    return files.orderBy(F.desc_nulls_last("modified_at"), "path").limit(limit)


def recent_packs(packs: DataFrame) -> DataFrame:
    """Packs newest first."""
    return packs.orderBy(F.desc_nulls_last("created_at"), "name")


def main_topics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The most frequent topic word of each text, ties alphabetically, ``General`` where there is none.

    Words are counted in the row: sorted, then folded into the longest run.
    """
    fold_start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit("General").alias("best"), F.lit(0).alias("most"))

    def step(s: Column, w: Column) -> Column:
        n = F.when(s["w"] == w, s["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), n.alias("n"), F.when(n > s["most"], w).otherwise(s["best"]).alias("best"), F.greatest(n, s["most"]).alias("most"))

    words = F.array_sort(topic_words(F.coalesce(F.col(text), F.lit(""))))
    return documents.select(key, F.aggregate(words, fold_start, step)["best"].alias("topic"))


def project_report(files: DataFrame, symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """The report's rows (``section, ord, label, value``): totals, most referenced types, kinds, recent files."""
    totals = repo_stats(files, symbols)
    pairs = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for i, c in enumerate(("files", "symbols", "size_bytes", "doc_lines", "code_lines"))])
    head = totals.select(F.explode(pairs).alias("p")).select(F.lit("totals").alias("section"), "p.*")
    from pyspark.sql import Window

    def listed(df: DataFrame, section: str, label: str, value: Column, *order: Column) -> DataFrame:  # a handful of rows
        return df.select(F.lit(section).alias("section"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("ord"), F.col(label).alias("label"), value.cast("string").alias("value"))

    types = listed(top_referenced(symbols, refs, 15), "types", "name", F.col("count"), F.desc("count"), F.asc("name"))
    kinds = listed(kind_histogram(symbols, 8), "kinds", "kind", F.col("n"), F.desc("n"), F.asc("kind"))
    recent = listed(recent_files(files, 10).select("path", "modified_at"), "recent", "path", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss"), F.desc_nulls_last("modified_at"), F.asc("path"))
    return head.unionByName(types).unionByName(kinds).unionByName(recent)


def compression_history(history: DataFrame) -> DataFrame:
    """Adds the ratio of naive to map tokens, 0 where nothing was there to map."""
    ratio = F.when(F.col("map_tokens") > 0, F.round(F.col("naive_tokens") / F.col("map_tokens"), 6)).otherwise(F.lit(0.0))
    return history.withColumn("compression_ratio", ratio)


def best_compression(history: DataFrame) -> DataFrame:
    """A10: greatest ratio, and the cycle and tokens of the last cycle."""
    h = compression_history(history)
    return h.agg(F.max("compression_ratio").alias("best_ratio"), F.max("cycle").alias("last_cycle"), F.max_by("map_tokens", "cycle").alias("last_map_tokens"))
