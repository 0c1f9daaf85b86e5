"""Maps, packets and carts under a token budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import map_entry, split_lines
from lodestone.functions.tokens import token_estimate
from lodestone.operators.symbols import IMPORTANT_KINDS, reference_counts

# Words that mark a line of a log as a failure, and the answer where there is none.
FAILURE_WORDS = ("error:", "failed")
NO_FAILURE = "No obvious failures found in log."


def fold_to_budget(rows: DataFrame, group: str, order: list[str], cost: str, budget: int) -> DataFrame:
    """In each group, rows are taken in order as long as they fit what is left of the budget; others are skipped, later ones tried.

    Adds ``taken`` and ``used`` (tokens taken up to and with the row). The fold keeps two numbers a group and streams over rows that are
    sorted within their partition, so even a group of any size is never gathered. Strictly below the budget, as packets are filled.
    """
    schema = rows.withColumn("taken", F.lit(True)).withColumn("used", F.lit(0).cast("bigint")).schema

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = object(), 0
        for b in batches:
            taken, at = [], []
            for g, c in zip(b[group], b[cost]):
                if g != now:
                    now, used = g, 0
                fits = used + int(c) < budget
                used += int(c) if fits else 0
                taken.append(fits)
                at.append(used)
            yield b.assign(taken=taken, used=at)

    return rows.repartition(group).sortWithinPartitions(group, *order).mapInPandas(fold, schema)


def map_candidates(symbols: DataFrame, focus: str | None = None) -> DataFrame:
    """symbols that may enter a map, with ``matches_focus``.

    A focus matches where one of its terms is part of the name or the documentation. Others need a file whose name has no ``test`` and,
    with a focus, an important kind; without one, an important kind, an access that is public or unknown, or a name that starts with test.
    """
    terms = [t for t in (focus or "").lower().split(" ") if t]
    text = F.concat_ws("\n", F.lower("name"), F.lower("doc_comment"))
    matches = F.lit(False)
    for t in terms:
        matches = matches | text.contains(t)
    base = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    important = F.col("kind").isin(*IMPORTANT_KINDS)
    public = F.col("access_level").isNull() | F.col("access_level").isin("public", "open")
    other = ~base.contains("test") & (important if focus is not None else important | public | F.lower("name").startswith("test"))
    return symbols.withColumn("matches_focus", F.coalesce(matches, F.lit(False))).filter(F.col("matches_focus") | F.coalesce(other, F.lit(False)))


def map_entries(candidates: DataFrame) -> DataFrame:
    """Rendered entries, equal ones once: first place, focus if any has it; ``entry, path, start_line, matches_focus, refs, kind``."""
    entry = map_entry(F.col("path"), F.col("name"), F.col("signature"), F.col("start_line"), F.col("end_line"), F.col("doc_comment"))
    rows = candidates.withColumn("entry", entry)
    place = F.min(F.struct("path", "start_line", "kind")).alias("p")
    return rows.groupBy("entry").agg(place, F.max("matches_focus").alias("matches_focus"), F.max("ref_count").alias("refs")).select("entry", "p.*", "matches_focus", "refs")


def focus_entries(entries: DataFrame) -> DataFrame:
    """Entries, and those in focus once more behind ``FOCUS: ``."""
    again = entries.filter("matches_focus").withColumn("entry", F.concat(F.lit("FOCUS: "), F.col("entry")))
    return entries.unionByName(again)


def map_score() -> Column:
    """5 for the focus, log of references, and 1 for an important kind."""
    return F.round(F.when(F.col("matches_focus"), 5.0).otherwise(0.0) + F.log1p(F.col("refs").cast("double")) + F.when(F.col("kind").isin(*IMPORTANT_KINDS), 1.0).otherwise(0.0), 6)


def repo_map(symbols: DataFrame, refs: DataFrame, budget: int = 4096, focus: str | None = None) -> DataFrame:
    """The best entries that fit the budget: ``rank, entry, score, tokens``, filled greedily in order of score, path, line.

    Of entries of one size t, once one does not fit, none behind it does, so only the first ``budget`` / t of them can ever be taken. These
    are picked by a limited window, which is cut down on the map side; all sizes together have at most ``budget`` * ln(``budget``), and one
    task folds them. Ranks are places among all entries: each entry finds, by bisection, the taken ones ahead of it, and is counted.
    """
    from pyspark.sql import Window

    entries = map_entries(reference_counts(map_candidates(symbols, focus), refs))
    key = F.struct((-F.col("score")).alias("s"), "path", "start_line", "entry").alias("key")
    scored = entries.select("entry", "path", "start_line", map_score().alias("score"), token_estimate("entry").alias("tokens")).select("entry", "score", "tokens", key)
    nth = F.row_number().over(Window.partitionBy("tokens").orderBy("key"))
    able = scored.filter(F.col("tokens") < budget).withColumn("nth", nth).filter(F.col("nth") <= budget).filter(F.col("nth") * F.col("tokens") < budget)
    taken = fold_to_budget(able.drop("nth").withColumn("g", F.lit(0)), "g", ["key"], "tokens", budget).filter("taken")
    taken = taken.select("entry", "score", "tokens", "key", F.row_number().over(Window.orderBy("key")).alias("at"))  # at most ``budget`` rows

    def ahead(keys: Column, k: Column) -> Column:
        """How many of the sorted keys are less than ``k``."""

        def halve(s: Column, _: Column) -> Column:
            mid = ((s["lo"] + s["hi"]) / 2).cast("int")
            step = F.when(F.element_at(keys, mid + 1) < k, F.struct((mid + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid.alias("hi")))
            return F.when(s["lo"] < s["hi"], step).otherwise(s)

        start = F.struct(F.lit(0).alias("lo"), F.size(keys).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(budget.bit_length() + 1)), start, halve)["lo"]

    keys = taken.agg(F.sort_array(F.collect_list("key")).alias("_keys"))  # one row
    counts = scored.select("key").crossJoin(F.broadcast(keys)).select((ahead(F.col("_keys"), F.col("key")) + 1).alias("at")).groupBy("at").agg(F.count("*").alias("n"))
    ranks = counts.select("at", F.sum("n").over(Window.orderBy("at")).cast("int").alias("rank"))
    return taken.join(ranks, "at").select("rank", "entry", "score", "tokens")


def failure_lines(logs: DataFrame, key: str = "doc_id", text: str = "text", most: int = 10) -> DataFrame:
    """The first failure lines of each log, or a fixed sentence."""
    lower = lambda x: F.lower(x)
    hits = F.filter(split_lines(F.coalesce(F.col(text), F.lit(""))), lambda x: lower(x).contains(FAILURE_WORDS[0]) | lower(x).contains(FAILURE_WORDS[1]))
    return logs.select(key, F.when(F.size(hits) > 0, F.array_join(F.slice(hits, 1, most), "\n")).otherwise(F.lit(NO_FAILURE)).alias("failures"))


def pack_items(packs: DataFrame) -> DataFrame:
    """Items of each pack in order, a path and kind once at its first place; packs without items have none."""
    flat = packs.select(F.col("name").alias("pack"), F.posexplode("items").alias("pos", "item")).select("pack", "pos", "item.*")
    return flat.filter("path is not null").groupBy("pack", "path", "kind").agg(F.min("pos").alias("pos"), F.min_by("reason", "pos").alias("reason"))


def save_packs(packs: DataFrame, new: DataFrame) -> DataFrame:
    """Packs after saving others: a new pack takes the place of one of the same name. Of several new ones, the last created."""
    rest = [c for c in new.columns if c != "name"]
    last = new.groupBy("name").agg(F.max_by(F.struct(*rest), "created_at").alias("_r")).select("name", *[F.col(f"_r.{c}").alias(c) for c in rest])
    return packs.join(last.select("name"), "name", "left_anti").select(*last.columns).unionByName(last)


def delete_packs(packs: DataFrame, names: DataFrame) -> DataFrame:
    """Packs without those named; their items go with them."""
    return packs.join(names.select("name").distinct(), "name", "left_anti")


def cart_by_kind(items: DataFrame) -> DataFrame:
    """How many items and paths of each kind a cart holds."""
    return items.groupBy("pack", F.coalesce("kind", F.lit("file")).alias("kind")).agg(F.count("*").alias("items"), F.countDistinct("path").alias("paths"), F.min("path").alias("first_path"))


def cart_symbols(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Items of kind symbol, written ``Symbol::path``, with what they point to; keys of another form have no match."""
    parts = F.filter(F.split("path", "::"), lambda x: x != "")
    keyed = items.filter("kind = 'symbol'").withColumn("_p", parts).filter(F.size("_p") == 2)
    named = keyed.select("pack", "pos", F.element_at("_p", 1).alias("qualified_name"), F.element_at("_p", 2).alias("path"))
    return named.join(symbols.select("qualified_name", "path", "start_line", "end_line", "kind"), ["qualified_name", "path"])


def cart_sections(items: DataFrame, files: DataFrame, outlines: DataFrame) -> DataFrame:
    """Each item's section. An item whose reason says that it was included or defines something comes as a skeleton (its outline,
    if there is one), any other in full. Where ``outlines`` have a ``heading`` (D07), it heads skeletons. Symbol items are kept. Items without a
    current file have an empty body."""
    from lodestone.functions.text import fence_of

    reason = F.coalesce("reason", F.lit("Directly Added"))
    skeleton = reason.contains("Defines") | reason.contains("Included")
    heads = outlines.select("path", "outline", F.col("heading") if "heading" in outlines.columns else F.lit(None).cast("string").alias("heading"))
    joined = items.join(files.select("path", "content"), "path", "left").join(heads, "path", "left")
    mode = F.when(skeleton & F.col("outline").isNotNull(), "SKELETON").otherwise("FULL")
    body = F.when(mode == "SKELETON", F.col("outline")).otherwise(F.coalesce("content", F.lit("")))
    title = F.when(mode == "SKELETON", F.coalesce("heading", "path")).otherwise(F.col("path"))
    section = F.concat(F.lit("## "), title, F.lit(" ("), mode, F.lit(", "), reason, F.lit(")\n```"), fence_of("path"), F.lit("\n"), body, F.lit("\n```\n"))
    return joined.select("pack", "pos", "path", "kind", mode.alias("mode"), section.alias("section"), token_estimate(section).alias("tokens"))


def headed_outlines(symbols: DataFrame) -> DataFrame:
    """Outlines with the heading that D07 gives a skeleton."""
    one = symbols.groupBy("path").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.min("signature").alias("signature"))
    names = F.when(F.col("n") == 1, F.array("name")).otherwise(F.array(F.lit(""), F.lit("")))
    return outlines(symbols).join(one.select("path", skeleton_heading(F.col("path"), names, F.array("signature")).alias("heading")), "path")


def packed_carts(sections: DataFrame, budget: int) -> DataFrame:
    """D06 over carts: which sections of each pack fit: full files first, then skeletons, each in order."""
    rows = sections.select("pack", F.when(F.col("mode") == "FULL", 0).otherwise(1).alias("class"), "pos", "path", "kind", "mode", "tokens")
    return fold_to_budget(rows, "pack", ["class", "pos", "path", "kind"], "tokens", budget)


def rendered_carts(sections: DataFrame, budget: int) -> DataFrame:
    """Each cart as one packet: ``pack, sections, tokens, text``. Tokens are those of all sections that fit; the header that states them
    goes ahead and is not counted. A packet's sections are within the budget, so they fit a task; a cart of which nothing fits has a
    header alone."""
    taken = packed_carts(sections, budget).select("pack", "pos", "class", "taken").join(sections.select("pack", "pos", "section"), ["pack", "pos"])
    parts = F.sort_array(F.collect_list(F.when(F.col("taken"), F.struct("class", "pos", "section"))))
    body = F.array_join(F.transform("parts", lambda x: x["section"]), "")
    rows = taken.groupBy("pack").agg(parts.alias("parts")).select("pack", F.size("parts").alias("sections"), body.alias("body")).withColumn("tokens", token_estimate("body"))
    return rows.select("pack", "sections", "tokens", F.concat(packet_header(F.col("tokens"), budget), F.lit("\n\n"), "body").alias("text"))


def packet_header(used: Column, budget: int) -> Column:
    """First line of a packet."""
    return F.concat(F.lit("# Context Packet (Tokens: "), used.cast("string"), F.lit(f"/{budget})"))


def skeleton_heading(path: Column, names: Column, signatures: Column) -> Column:
    """A skeleton of exactly one symbol that bears its file's name is headed by its signature, any other by its path."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    return F.when((F.size(names) == 1) & (F.lower(F.try_element_at(names, F.lit(1))) == F.lower(base)), F.try_element_at(signatures, F.lit(1))).otherwise(path)


def outlines(symbols: DataFrame) -> DataFrame:
    """The outline of each file: one line a symbol by its place, indented by nesting in Swift (with documentation) and Kotlin."""
    from lodestone.functions.text import language_of

    lang = language_of("path")
    depth = F.when(lang == "swift", F.size(F.split("qualified_name", r"\.")) - 1).when(lang == "kotlin", F.when(F.coalesce("enclosing_type", F.lit("")) == "", 0).otherwise(F.size(F.split("enclosing_type", r"\.")))).otherwise(F.lit(0))
    pad = F.repeat(F.lit("  "), depth)
    line = F.concat(pad, F.coalesce("signature", "name", F.lit("")), F.lit(" [L"), F.col("start_line").cast("string"), F.lit("-L"), F.col("end_line").cast("string"), F.lit("]"))
    doc = F.when((lang == "swift") & (F.coalesce("doc_comment", F.lit("")) != ""), F.concat(pad, F.lit("/// "), F.regexp_replace("doc_comment", "\n", F.concat(F.lit("\n"), pad, F.lit("/// "))), F.lit("\n"))).otherwise(F.lit(""))
    rows = symbols.select("path", F.struct("start_line", "end_line", "qualified_name", F.concat(doc, line).alias("text")).alias("s"), "name", "signature")
    return rows.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["text"]), "\n").alias("outline"), F.count("*").alias("symbols"))
