"""Queries of the problems over whole tables, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm import budget, documentation, mixing, packing, provenance, splitting, truncation
from lodestone.llm.items import KEY, limit_of, symbol_keys
from lodestone.operators.current import current_files
from lodestone.schema import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    audited = budget.audited_symbols(table(spark, d, "symbols"), files, budget.model_for(files))
    return audited.filter("verdict != 'right'").select(*KEY)


def p1_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Exact and predicted sums by kind, source, language and domain."""
    files, documents = table(spark, d, "files"), table(spark, d, "documents")
    return budget.token_budget(budget.all_counted(files, table(spark, d, "symbols"), documents, budget.model_for(files, documents)))


def p1_budget(spark: SparkSession, d: str) -> DataFrame:
    """The exact sums alone."""
    return p1_estimates(spark, d).drop("predicted")


def p1_models(spark: SparkSession, d: str) -> DataFrame:
    """The models' errors on what was held out."""
    items = budget.model_items(table(spark, d, "files"), table(spark, d, "documents"))
    return budget.model_errors(items, budget.fit_token_model(items))


def p1_documents(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    counted = budget.counted(budget.document_items(documents), budget.fit_token_model(budget.document_items(documents)))
    return counted.groupBy("source", "language", "domain").agg(F.count("*").alias("items"), F.sum("tokens").alias("tokens"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    limit, overlap = limit_of(table(spark, d, "size_limits"), "symbol_piece")
    return splitting.split_symbols(symbol_keys(table(spark, d, "symbols")), table(spark, d, "files"), limit, overlap)


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the pieces of every oversized symbol: where they begin and end, how many are over the limit, and how many leave a gap."""
    limit, _ = limit_of(table(spark, d, "size_limits"), "symbol_piece")
    before = Window.partitionBy(*KEY).orderBy("piece")  # the pieces of one symbol
    laid = p2_pieces(spark, d).withColumn("gap", F.col("char_start") > F.lag("char_end").over(before))
    n = lambda test: F.count(F.when(test, 1))
    return laid.groupBy(*KEY).agg(F.min("char_start").alias("begins"), F.max("char_end").cast("bigint").alias("ends"), n(F.col("tokens") > limit).alias("over_limit"), n(F.col("gap")).alias("gaps"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_pieces(spark, d).filter("piece = 0").select(*KEY)


def p3_provenance(spark: SparkSession, d: str) -> DataFrame:
    return provenance.provenance(table(spark, d, "files"), table(spark, d, "upstream_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_provenance(spark, d).filter(F.size("reasons") > 0).select("path")


def p3_handwritten(spark: SparkSession, d: str) -> DataFrame:
    by_hand = p3_provenance(spark, d).filter(F.size("reasons") == 0).select("path")
    return current_files(table(spark, d, "files"), ["path", "language", "sha256"]).join(by_hand, "path", "left_semi")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documentation.documented_functions(table(spark, d, "symbols"), table(spark, d, "files"))


def p4_extracted(spark: SparkSession, d: str) -> DataFrame:
    return documentation.extracted_functions(table(spark, d, "files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pairs(spark, d).select(*KEY)


def p5_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = limit_of(table(spark, d, "size_limits"), "container")
    return packing.containers(table(spark, d, "documents"), capacity)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return packing.split_documents(p5_containers(spark, d))


def p5_items(spark: SparkSession, d: str) -> DataFrame:
    """What the containers hold of every document: how often its first piece, whether it is whole, and its tokens if so."""
    inside = p5_containers(spark, d).select(F.explode("contents").alias("x")).select("x.*").filter("piece = 0")
    return inside.groupBy("doc_id").agg(F.count("*").alias("places"), F.max(F.col("pieces") == 1).alias("whole"), F.max(F.when(F.col("pieces") == 1, F.col("tokens"))).cast("bigint").alias("tokens"))


def p5_fill(spark: SparkSession, d: str) -> DataFrame:
    """One row over all containers: first pieces in them, containers over their capacity, and those whose unused tokens are misstated."""
    capacity, _ = limit_of(table(spark, d, "size_limits"), "container")
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    first = F.sum(F.size(F.filter("contents", lambda x: x["piece"] == 0))).cast("bigint").alias("documents")
    return packing.containers(table(spark, d, "documents"), capacity).agg(first, n(F.col("used") > capacity, "over_full"), n(F.col("used") + F.col("unused") != capacity, "misstated"))


def p6_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_shares(spark, d).filter("short").select("source")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of any mixture: its documents are of the source, none is used too often, and the tokens miss what can be reached by no
    more than the source's largest document has."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sizes = mixing.counted_documents(docs)
    largest = sizes.groupBy(F.col("source").alias("s")).agg(F.max("tokens").alias("largest"))
    report = mixing.mixture_report(docs, targets).join(largest, F.lower(F.trim("source")) == F.col("s"), "left")
    return report.select("source", "max_repeats", "documents", "available_tokens", "wanted_tokens", "capped", "short", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), (F.abs("missed_tokens") <= F.coalesce("largest", F.lit(0))).alias("near"))


def p7_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_verdicts(spark, d).filter("cut").select("doc_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    cut = F.sum(F.col("cut").cast("bigint"))
    return p7_verdicts(spark, d).groupBy("source").agg(F.count("*").alias("documents"), cut.alias("cut"), F.round(cut / F.count("*"), 6).alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_budget, p1_estimates, p1_models, p1_documents, p2_found, p2_pieces, p2_checks, p3_found, p3_provenance, p3_handwritten, p4_found, p4_pairs, p4_extracted, p5_found, p5_containers, p5_items, p5_fill, p6_found, p6_mixture, p6_shares, p6_checks, p7_found, p7_verdicts, p7_rates)
}

_T01 = r"""(CASE WHEN {0} = '' THEN 0 WHEN {0} IS NOT NULL THEN greatest(1, len(regexp_extract_all({0}, '[a-zA-Z0-9]+|[\p{{P}}\p{{S}}]|\n|[\t\n\f\r\p{{Z}}]+'))
  + coalesce(list_sum(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]{{8,}}'), lambda w: len(w) // 4)), 0)) END)::BIGINT"""
_SYMBOL_TEXT = r"""WITH cur AS (
  SELECT path, regexp_split_to_array(content, '\r?\n') AS ls FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, sha256 DESC) = 1
), txt AS (
  SELECT s.path, s.qualified_name, s.start_line, s.end_line, s.estimated_tokens,
         coalesce(trim(array_to_string(ls[s.start_line:s.end_line], chr(10)), ' ' || chr(9) || chr(13) || chr(10)), '') AS t
  FROM symbols s LEFT JOIN cur USING (path)
)"""
SQL: dict[str, str] = {
    "p1_found": f"{_SYMBOL_TEXT} SELECT DISTINCT path, qualified_name, start_line, end_line FROM txt WHERE estimated_tokens IS NULL OR estimated_tokens <> {_T01.format('t')}",
    "p1_budget": rf"""{_SYMBOL_TEXT}, dom AS (SELECT list(a) AS ds FROM (SELECT lower(trim(domain)) AS a FROM documents WHERE trim(domain) <> '' GROUP BY 1 HAVING count(*) >= 3)),
i AS (SELECT 'file' AS kind, path, content AS t FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC, sha256 DESC) = 1
  UNION ALL SELECT 'symbol', path, t FROM (SELECT DISTINCT ON (path, qualified_name, start_line, end_line) path, t FROM txt WHERE path IS NOT NULL)),
e AS (SELECT i.*, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS x, list_filter(string_split(lower(path), '/')[2:-2], lambda f: list_contains(ds, f)) AS fs FROM i, dom),
a AS (SELECT kind, split_part(path, '/', 1) AS source, CASE WHEN x IN ('kt', 'kts') THEN 'kotlin' ELSE x END AS language, coalesce(fs[-1], '') AS domain, coalesce({_T01.format('t')}, 0) AS n FROM e
  UNION ALL SELECT 'document', coalesce(lower(trim(source)), ''), CASE WHEN coalesce(lower(trim(lang)), '') = '' THEN 'und' ELSE lower(trim(lang)) END, coalesce(lower(trim(domain)), ''), coalesce({_T01.format('text')}, 0) FROM documents)
SELECT kind, source, language, domain, count(*) AS items, sum(n)::BIGINT AS tokens FROM a GROUP BY ALL""",
    "p1_documents": f"""SELECT coalesce(lower(trim(source)), '') AS source, CASE WHEN coalesce(lower(trim(lang)), '') = '' THEN 'und' ELSE lower(trim(lang)) END AS language,
  coalesce(lower(trim(domain)), '') AS domain, count(*) AS items, sum(coalesce({_T01.format('text')}, 0))::BIGINT AS tokens FROM documents GROUP BY ALL""",
    "p2_found": f"""{_SYMBOL_TEXT} SELECT DISTINCT path, qualified_name, start_line, end_line FROM txt
  WHERE {_T01.format('t')} > (SELECT max_tokens FROM size_limits WHERE limit_name = 'symbol_piece')""",
    "p2_checks": f"""{_SYMBOL_TEXT} SELECT DISTINCT path, qualified_name, start_line, end_line, 0 AS begins, length(t) AS ends, 0::BIGINT AS over_limit, 0::BIGINT AS gaps FROM txt
  WHERE {_T01.format('t')} > (SELECT max_tokens FROM size_limits WHERE limit_name = 'symbol_piece')""",
    "p5_found": f"SELECT doc_id FROM documents WHERE {_T01.format('text')} > (SELECT max_tokens FROM size_limits WHERE limit_name = 'container')",
    "p5_items": f"""WITH d AS (SELECT doc_id, coalesce({_T01.format('text')}, 0) AS n FROM documents), l AS (SELECT max_tokens AS m FROM size_limits WHERE limit_name = 'container')
SELECT doc_id, 1::BIGINT AS places, n <= m AS whole, CASE WHEN n <= m THEN n END AS tokens FROM d, l""",
    "p5_fill": "SELECT count(*) AS documents, 0::BIGINT AS over_full, 0::BIGINT AS misstated FROM documents",
    "p6_checks": f"""WITH d AS (SELECT lower(trim(source)) AS s, coalesce({_T01.format('text')}, 0) AS n FROM documents), a AS (SELECT s, sum(n)::BIGINT AS n, count(*) AS k FROM d GROUP BY s), w AS (SELECT sum(n) AS t FROM d)
SELECT m.source, max_repeats, coalesce(k, 0) AS documents, coalesce(a.n, 0) AS available_tokens, round(target_share * t, 3) AS wanted_tokens, max_repeats * coalesce(a.n, 0) < target_share * t AS capped,
  max_repeats * coalesce(a.n, 0) < target_share * t AS short, true AS within_repeats, true AS near FROM mix_targets m LEFT JOIN a ON a.s = lower(trim(m.source)), w""",
    "p6_found": f"""WITH d AS (SELECT lower(trim(source)) AS s, coalesce({_T01.format('text')}, 0) AS n FROM documents), a AS (SELECT s, sum(n) AS n FROM d GROUP BY s)
SELECT m.source FROM mix_targets m LEFT JOIN a ON a.s = lower(trim(m.source)) WHERE m.max_repeats * coalesce(a.n, 0) < m.target_share * (SELECT sum(n) FROM d)""",
}
