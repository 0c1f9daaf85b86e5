"""Views of symbols and references: kinds decoded, keys unique, names joined to definitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import body_of_lines, split_lines
from lodestone.operators.current import current_files
from lodestone.operators.skew import skew_join
from lodestone.schema import KINDS
from lodestone.session import ensure_checkpoint_dir

KEY = ["path", "qualified_name", "start_line", "end_line"]
# Kinds that count as types for the reference ranking, and as important for maps.
RANKED_KINDS = ("class", "struct", "protocol", "actor", "enum", "interface", "style")
IMPORTANT_KINDS = ("class", "struct", "protocol", "actor", "enum", "interface", "case")
# Names of primitives that never count as referenced types.
PRIMITIVES = (
    "String", "Int", "Bool", "Double", "Float", "Data", "Date", "URL", "Array", "Dictionary", "Set", "self", "Self", "Any", "AnyObject",
    "string", "number", "boolean", "any", "unknown", "never", "void", "Promise", "Object", "this", "window", "document", "console",
    "int", "float", "str", "bool", "list", "dict", "set", "tuple", "object", "cls",
)


def decoded_kind(kind: Column | str = "kind") -> Column:
    """A known kind as it is; any other text and null as ``function``."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k.isin(*KINDS), k).otherwise(F.lit("function"))


def unique_symbols(symbols: DataFrame) -> DataFrame:
    """One row per symbol key; of rows that differ otherwise, the greatest value of each column. Copies meet on the map side."""
    rest = ["name", "signature", "enclosing_type", "access_level", "doc_comment", "estimated_tokens"]
    return symbols.groupBy(*KEY).agg(F.max(decoded_kind()).alias("kind"), *[F.max(c).alias(c) for c in rest])


def symbol_bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """T09 over J02: the body of every symbol in the current content; '' for a path without file."""
    lines = current_files(files, ["path", "content"]).select("path", split_lines("content").alias("_lines"))  # once a file
    body = F.coalesce(body_of_lines("_lines", "start_line", "end_line"), F.lit(""))
    return unique_symbols(symbols).join(lines, "path", "left").select(*KEY, "name", body.alias("body"))


def reference_counts(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Each symbol with how often its name is referenced, 0 if never. References are counted before they are joined."""
    counts = refs.groupBy("name").agg(F.count("*").alias("ref_count"))
    return skew_join(symbols, counts, ["name"]).withColumn("ref_count", F.coalesce("ref_count", F.lit(0)))


def references_of(refs: DataFrame, name: str) -> DataFrame:
    """The references to a name."""
    return refs.filter(F.col("name") == name)


def definitions_referenced(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """J01 by name: references times definitions, as the many-to-many join counts them, without making its pairs."""
    r = refs.filter("name is not null").groupBy("name").agg(F.count("*").alias("references"))
    s = symbols.filter("name is not null").groupBy("name").agg(F.count("*").alias("definitions"))
    return r.join(s, "name").withColumn("joined", F.col("references") * F.col("definitions"))


def top_referenced(symbols: DataFrame, refs: DataFrame, limit: int = 20, kinds: tuple[str, ...] = RANKED_KINDS) -> DataFrame:
    """Names of types, or of other ``kinds``, by joined reference count, without primitives; ties by name."""
    types = symbols.filter(F.col("kind").isin(*kinds))
    counted = definitions_referenced(types, refs.filter(~F.col("name").isin(*PRIMITIVES)))
    return counted.select("name", F.col("joined").alias("count")).orderBy(F.desc("count"), "name").limit(limit)


def unused_symbols(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """Symbols whose name nothing references; files and tests are no candidates."""
    named = refs.filter("name is not null").select("name").distinct()
    return symbols.filter(~F.col("kind").isin("file", "test")).join(named, "name", "left_anti")


def symbols_under(symbols: DataFrame, files: DataFrame, prefix: str) -> DataFrame:
    """Symbols of indexed files below a path prefix."""
    under = files.filter(F.col("path").startswith(prefix)).select("path").distinct()
    return symbols.join(under, "path", "left_semi")


def _sweep(inner: DataFrame, outer: DataFrame, answer: Callable[[list[tuple[int, int, str]], int, int, str], str | None], column: str) -> DataFrame:
    """For each distinct range of ``inner`` (``path, start_line, end_line, qualified_name``) what ``answer`` says of the ranges of ``outer`` that
    are open at its first line.

    Both are sorted by place within their paths and pass by once; the ranges that are open at a line are all that is held, so neither the
    length of a range nor the size of a file counts. Rows come distinct, so that a path has no more of them than its lines and symbols.
    """
    columns = ["path", "start_line", "end_line", "qualified_name"]
    events = outer.select(*columns).distinct().withColumn("asks", F.lit(False)).unionByName(inner.select(*columns).distinct().withColumn("asks", F.lit(True)))

    def pass_by(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, open_ = None, []
        for b in batches:
            rows = []
            for p, first, last, name, asks in zip(b["path"], b["start_line"].tolist(), b["end_line"].tolist(), b["qualified_name"], b["asks"].tolist()):
                if p != path:
                    path, open_ = p, []
                if not asks:
                    open_.append((first, last, name))
                    continue
                if any(x[1] < first for x in open_):
                    open_ = [x for x in open_ if x[1] >= first]
                rows.append((p, first, last, name, answer(open_, first, last, name)))
            yield pd.DataFrame(rows, columns=[*columns, column])

    kept = events.filter("path is not null and start_line is not null and end_line is not null")
    schema = f"path string, start_line int, end_line int, qualified_name string, {column} string"
    return kept.repartition("path").sortWithinPartitions("path", "start_line", "asks", "end_line", "qualified_name").mapInPandas(pass_by, schema)


def _innermost(open_: list[tuple[int, int, str]], first: int, last: int, name: str) -> str | None:
    around = [x for x in open_ if x[1] >= last and x[2] is not None]
    return min(around, key=lambda x: (x[1] - x[0], -len(x[2]), x[2]))[2] if around else None


def _containers(open_: list[tuple[int, int, str]], first: int, last: int, name: str) -> str:
    around = sorted((x[0], x[0] - x[1], x[2]) for x in open_ if x[1] >= last and x[2] is not None and (x[0] != first or x[2] != name))
    return " > ".join(x[2] for x in around)


def enclosing_symbol(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each reference the smallest symbol of its file whose lines hold it; ties by longest name, then first.

    Only the distinct places of references are looked up, in one sweep over each file. Repeated references stay apart only by their
    count. References without path are dropped; those without lines have no context.
    """
    place = ["path", "start_line", "end_line"]
    r = refs.filter("path is not null").groupBy("path", "name", "start_line", "end_line").agg(F.count("*").alias("references"))
    outer = symbols.filter("start_line <= end_line and qualified_name is not null")
    found = _sweep(r.select(*place, F.lit(None).cast("string").alias("qualified_name")), outer, _innermost, "context")
    return skew_join(r, found.select(*place, "context"), place).select("path", "name", "start_line", "end_line", "references", "context")


def enclosing_types(symbols: DataFrame) -> DataFrame:
    """J09 for symbols: names of the types around each, outermost first."""
    types = symbols.filter(F.col("kind").isin("class", "struct", "actor", "enum", "protocol", "interface", "extension", "object", "companion", "dataClass", "sealedClass", "valueClass"))
    return _sweep(symbols, types.filter("start_line <= end_line"), _containers, "containers").select(*KEY, "containers")


def dependency_crawl(staged: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that define what a staged file names. ``staged`` has ``stage, path``; gives ``stage, path, reason``.

    A reference resolves where its name is a definition's qualified name in another file; the reason is the least name. Names that nothing
    defines are dropped first. Of a stage and a name only one row is left, with the only file that names it or none if several do, since
    a definition in any file is then in another one than some of them. Its definitions, which are results but for that one file,
    are spread over tasks where a name has very many.
    """
    ensure_checkpoint_dir(symbols.sparkSession)
    defined = symbols.filter("qualified_name is not null").select(F.col("qualified_name").alias("name"), "path").distinct().checkpoint()  # narrow, read three times
    names = refs.filter("name is not null").select("path", "name").distinct().join(defined.select("name").distinct(), "name", "left_semi")
    used = staged.filter("path is not null").select("stage", "path").distinct().join(names, "path")
    once = F.when(F.min("path") == F.max("path"), F.min("path"))
    named = used.groupBy("stage", "name").agg(once.alias("only_from"))
    hits = skew_join(defined, named, ["name"], "inner").filter("only_from is null or only_from <> path")
    return hits.groupBy("stage", "path").agg(F.concat(F.lit("Defines "), F.min("name")).alias("reason"))


def auto_expand(carts: DataFrame, refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """What ``dependency_crawl`` adds to each cart (``stage, path``) that is not in it yet."""
    return dependency_crawl(carts, refs, symbols).join(carts, ["stage", "path"], "left_anti")


def live_symbols(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """Search hits (``qualified_name, score``) with the first current symbol of that name; hits without one are stale and go."""
    first = symbols.groupBy("qualified_name").agg(F.min(F.struct("path", "start_line", "end_line", "kind", "signature")).alias("s"))
    return hits.join(first, "qualified_name").select("qualified_name", "score", "s.*")
