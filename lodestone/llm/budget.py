"""Problem 1: tokens of files, symbols and documents, and their sums by source, language and domain.

Tokens are predicted by one linear regression a language on bytes, words, digits, punctuation, gaps and script counts. A share of the
items, chosen by a hash of the key, is tokenized: one part fits the models (as sums of products, so that no item leaves its task),
another is held out to correct each model's bias. The predictions are applied everywhere; T01 itself comes from the same pass over the
characters, so the exact count is given beside the prediction and decides whether a recorded estimate is right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import language_of
from lodestone.functions.tokens import MEASURES, measures
from lodestone.llm.items import KEY, symbol_keys, with_text
from lodestone.operators.current import current_files, repository_of
from lodestone.operators.skew import skew_join
from lodestone.session import ensure_checkpoint_dir

#: Of 16 parts of the items by hash, how many fit the models and how many are held out.
PARTS, FIT, HELD = 16, 1, 1
#: Tokenized items that a language needs for a model of its own, and models at most (those with the most items); other languages
#: share the pooled one, which is fitted on the items of all languages.
OWN_MODEL, MODELS = 12, 200
#: Documents that must name a domain, in any spelling, for it to be an area that paths can name.
DOMAIN_DOCUMENTS = 3
#: A recorded estimate is implausible if it is further from the prediction than this share of it plus this many tokens.
FAR_SHARE, FAR_TOKENS = 0.5, 8

FEATURES = MEASURES[1:]
POOLED = ""


@dataclass(frozen=True)
class TokenModel:
    """Coefficients and bias factor of every language; ``POOLED`` stands for all that have no model of their own."""

    coefficients: dict[str, tuple[float, ...]]
    factor: dict[str, float]
    fitted: dict[str, int]  # items that each model was fitted on

    def predict(self, measured: Column, language: Column) -> Column:
        """Predicted T01 from a text's ``MEASURES``: between 1 and the bytes of the text, 0 for an empty one."""
        names = [x for x in self.coefficients if x != POOLED]
        x = F.transform(F.slice(measured, 2, len(FEATURES)), lambda v: v.cast("double"))

        def value(name: str) -> Column:
            return F.array(*[F.lit(float(c) * self.factor[name]) for c in self.coefficients[name]])

        pairs = [y for n in names for y in (F.lit(n), value(n))]
        own = F.try_element_at(F.create_map(*pairs), F.coalesce(language, F.lit(POOLED))) if pairs else F.lit(None)
        w = F.coalesce(own, value(POOLED))
        total = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)
        size = F.element_at(measured, 2).cast("double")
        return F.when(size > 0, F.greatest(F.lit(1.0), F.least(size, total))).otherwise(F.lit(0.0))


def _sums(k: int) -> list[Column]:
    x, y = (lambda i: F.element_at("m", i + 2).cast("double")), F.element_at("m", 1).cast("double")
    out = [F.sum(x(i) * x(j)).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)]
    singles = [f(i) for i in range(k) for f in (lambda i: F.sum(x(i) * y).alias(f"q{i}"), lambda i: F.sum(x(i)).alias(f"s{i}"))]
    return [*out, *singles, F.sum(y).alias("y"), F.count("*").alias("n")]


def sampled(items: DataFrame) -> DataFrame:
    """The tokenized part of items (``key, language, text``): ``language, fit, m``; one half fits the models, the other is held out."""
    part = F.pmod(F.xxhash64("key"), F.lit(PARTS))
    return items.filter(part < FIT + HELD).select((part < FIT).alias("fit"), F.coalesce("language", F.lit("und")).alias("language"), measures("text").alias("m"))


def fit_token_model(items: DataFrame) -> TokenModel:
    """Models from items (``key, language, text``) by one pass over the sample, in which each language becomes a row of sums.

    These rows are few numbers a language; of them leave the cluster the two sums over all languages, and those of at most ``MODELS``
    languages, each with its held-out half.
    """
    k = len(FEATURES)
    ensure_checkpoint_dir(items.sparkSession)
    sums = sampled(items).groupBy("language", "fit").agg(*_sums(k)).checkpoint()
    pooled = {r["fit"]: r.asDict() for r in sums.groupBy("fit").agg(*[F.sum(c).alias(c) for c in sums.columns if c not in ("language", "fit")]).collect()}
    largest = sums.filter(F.col("fit") & (F.col("n") >= OWN_MODEL)).orderBy(F.desc("n"), "language").limit(MODELS).select("language")
    rows = [r.asDict() for r in sums.join(F.broadcast(largest), "language").collect()]

    def matrices(r) -> tuple[np.ndarray, np.ndarray]:
        p = np.zeros((k, k))
        for i in range(k):
            for j in range(i, k):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"] or 0.0
        return p, np.array([r[f"q{i}"] or 0.0 for i in range(k)])

    def solve(r) -> np.ndarray:
        p, q = matrices(r)
        scale = np.sqrt(np.maximum(np.diag(p), 1e-9))
        return np.linalg.lstsq(p / np.outer(scale, scale) + 1e-6 * np.eye(k), q / scale, rcond=None)[0] / scale

    def bias(coefficients: np.ndarray, held) -> float:
        """Tokens of the held-out items over their predicted total, between a half and two."""
        if held is None or not held["y"]:
            return 1.0
        total = float(coefficients @ np.array([held[f"s{i}"] or 0.0 for i in range(k)]))
        return float(np.clip(held["y"] / total, 0.5, 2.0)) if total > 0 else 1.0

    fits = {r["language"]: r for r in rows if r["fit"]}
    held = {r["language"]: r for r in rows if not r["fit"]} | {POOLED: pooled.get(False)}
    base = solve(pooled[True]) if True in pooled else np.array([0.0, 1.0, 0.1, 1.0, 0.8, 0.0, 0.0])
    coefficients = {n: solve(r) for n, r in fits.items()} | {POOLED: base}
    factors = {n: bias(c, held.get(n)) for n, c in coefficients.items()}
    counts = {n: int(r["n"]) for n, r in fits.items()} | {POOLED: int(pooled[True]["n"]) if True in pooled else 0}
    return TokenModel({n: tuple(float(v) for v in c) for n, c in coefficients.items()}, factors, counts)


def model_errors(items: DataFrame, model: TokenModel) -> DataFrame:
    """How good the models are on the held-out items, by language: ``own_model``, held-out ``items`` with their ``tokens`` and ``predicted``
    total, ``total_error`` (of the total) and ``mean_error`` (of an item, as a share of its tokens)."""
    own = F.col("language").isin(*[n for n in model.coefficients if n != POOLED])
    held = sampled(items).filter(~F.col("fit")).select("language", own.alias("own_model"), F.element_at("m", 1).alias("tokens"), model.predict(F.col("m"), F.col("language")).alias("predicted"))
    share = F.abs(F.col("predicted") - F.col("tokens")) / F.greatest(F.lit(1), F.col("tokens"))
    sums = held.groupBy("language", "own_model").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.sum("predicted").alias("predicted"), F.round(F.avg(share), 6).alias("mean_error"))
    off = F.when(F.col("tokens") > 0, F.round(F.col("predicted") / F.col("tokens") - 1, 6)).otherwise(F.lit(0.0))
    return sums.withColumn("total_error", off).withColumn("predicted", F.round("predicted").cast("bigint"))


def domains_of(documents: DataFrame) -> DataFrame:
    """The areas of a corpus, ``area``: domains that at least ``DOMAIN_DOCUMENTS`` documents name."""
    named = documents.select(tidy("domain").alias("area")).filter("area <> ''").groupBy("area").agg(F.count("*").alias("n"))
    return named.filter(F.col("n") >= DOMAIN_DOCUMENTS).select("area")


def with_area(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Adds ``domain``: the area that ``path`` names, which is its last folder below the repository that is one, in lower case; '' if none is.

    Folders are told apart by name before they meet the areas, and paths by their folder, so a frequent folder name is one row.
    """
    folder = F.lower(F.regexp_extract("path", r"^[^/]*/(.*)/[^/]*$", 1))
    folders = rows.select(folder.alias("_folder")).distinct()
    parts = folders.select("_folder", F.posexplode(F.split("_folder", "/")).alias("at", "area"))
    told = skew_join(parts, domains_of(documents), ["area"], "inner").groupBy("_folder").agg(F.max_by("area", "at").alias("domain"))
    return skew_join(rows.withColumn("_folder", folder), told, ["_folder"]).drop("_folder").withColumn("domain", F.coalesce("domain", F.lit("")))


def tidy(c: str) -> Column:
    """A document's label trimmed in lower case, '' for null."""
    return F.coalesce(F.lower(F.trim(c)), F.lit(""))


def file_items(files: DataFrame) -> DataFrame:
    """Current files as items; ``with_area`` adds their domain from ``path``."""
    return current_files(files, ["path", "content"]).select(F.lit("file").alias("kind"), F.col("path").alias("key"), "path", repository_of("path").alias("source"), language_of("path").alias("language"), F.col("content").alias("text"))


def document_items(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("string").alias("path"), tidy("source").alias("source"), F.when(tidy("lang") == "", "und").otherwise(tidy("lang")).alias("language"), tidy("domain").alias("domain"), "text"
    )


def symbol_items(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbol keys as items, without a key column of their own."""
    return with_text(symbol_keys(symbols), files).select(F.lit("symbol").alias("kind"), "path", repository_of("path").alias("source"), language_of("path").alias("language"), "text")


def model_items(files: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """What models are fitted on: current files and, if given, documents; symbols are parts of files."""
    items = file_items(files).select("key", "language", "text")
    return items.unionByName(document_items(documents).select("key", "language", "text")) if documents is not None else items


def model_for(files: DataFrame, documents: DataFrame | None = None) -> TokenModel:
    return fit_token_model(model_items(files, documents))


def counted(items: DataFrame, model: TokenModel) -> DataFrame:
    """Items without their text, with ``predicted`` and exact ``tokens``; null texts count 0."""
    rest = [c for c in items.columns if c != "text"]
    return items.select(*rest, measures("text").alias("_m")).select(*rest, model.predict(F.col("_m"), F.col("language")).alias("predicted"), F.element_at("_m", 1).alias("tokens"))


def all_counted(files: DataFrame, symbols: DataFrame, documents: DataFrame, model: TokenModel) -> DataFrame:
    """Every current file, symbol and document: ``kind, source, language, domain, predicted, tokens``. Texts are counted before anything
    travels; only a path goes with the counts to find its area."""
    columns = ["kind", "source", "language", "domain", "predicted", "tokens"]
    of_paths = counted(file_items(files).drop("key"), model).unionByName(counted(symbol_items(symbols, files), model))
    return with_area(of_paths, documents).select(*columns).unionByName(counted(document_items(documents), model).select(*columns))


def token_budget(counts: DataFrame) -> DataFrame:
    """Sums by kind, source, language and domain: ``items``, exact ``tokens``, ``predicted`` tokens (rounded)."""
    return counts.groupBy("kind", "source", "language", "domain").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.round(F.sum("predicted")).cast("bigint").alias("predicted"))


def audited_symbols(symbols: DataFrame, files: DataFrame, model: TokenModel) -> DataFrame:
    """Each symbol key with its counts and what its recorded estimates are worth.

    ``verdict``: ``missing`` (a row without estimate), ``implausible`` (wrong, and far from the prediction), ``wrong``, or ``right``.
    """
    keys = symbol_keys(
        symbols,
        F.min("estimated_tokens").alias("low"),
        F.max("estimated_tokens").alias("high"),
        F.max(F.col("estimated_tokens").isNull()).alias("missing"),
    )
    known = [*KEY, "low", "high", "missing"]
    measured = with_text(keys, files).select(*known, measures("text").alias("_m"))
    c = measured.select(*known, model.predict(F.col("_m"), language_of("path")).alias("predicted"), F.element_at("_m", 1).alias("tokens"))
    far = F.greatest(F.abs(F.col("low") - F.col("predicted")), F.abs(F.col("high") - F.col("predicted"))) > FAR_SHARE * F.col("predicted") + FAR_TOKENS
    differs = (F.col("low") != F.col("tokens")) | (F.col("high") != F.col("tokens"))
    verdict = F.when(F.col("missing"), "missing").when(far & differs, "implausible").when(differs, "wrong").otherwise("right")
    return c.withColumn("verdict", verdict)
