"""The commands and messages of an index (section 2.13 of the survey) as one class over a store of tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import content_prefix
from lodestone.functions.tokens import count_tokens, token_estimate
from lodestone.operators import index, packets, search, stats, symbols
from lodestone.operators.current import current_files, latest
from lodestone.operators.extract import extract
from lodestone.schema import ACTIONS
from lodestone.session import ensure_checkpoint_dir
from lodestone.sources.ignore import ScanOptions
from lodestone.sources.scan import Settings, commit_files, complete_options, git_history, read_log, scan_repo

# What the explanations say.
EXPLANATIONS = {
    "index": "The index holds files, their symbols and the uses of names; unchanged files are skipped by their hash.",
    "pack": "A packet holds a map, the files that match a task and what they depend on, within a budget of tokens.",
    "symbol": "A symbol is a declaration with its place, signature, documentation and token estimate.",
}
EXPANDED = 10
_FAVORITE = "name string, file_path string, kind string, view_mode string, created_at timestamp_ntz, removed boolean"
_PACK = "name string, description string, created_at timestamp_ntz, items array<struct<path:string,kind:string,reason:string>>, removed boolean"


def _now() -> datetime:
    return datetime.now(timezone.utc).replace(tzinfo=None)


class Index:
    """An index of a source tree in a folder of Parquet tables.

    Every method that asks gives a DataFrame (or, for rendered texts, a string) and leaves the plan to Spark.
    """

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store

    # ------------------------------------------------------------------------------------------------------- building
    def index(self, root: str, options: ScanOptions | None = None, clean: bool = False, save_folders: bool = False) -> DataFrame:
        """``index``: scan, compare by hash, extract what changed. Gives updated, skipped and removed counts."""
        if save_folders and options:
            Settings.load(root).merged(options.exclude, options.include_folders).save(root)
        return index.update_index(self.spark, self.store, scan_repo(self.spark, root, options), clean)

    @property
    def files(self) -> DataFrame:
        return index.read_index(self.spark, self.store)["files"]

    @property
    def symbols(self) -> DataFrame:
        return index.read_index(self.spark, self.store)["symbols"]

    @property
    def refs(self) -> DataFrame:
        return index.read_index(self.spark, self.store)["symbol_refs"]

    # --------------------------------------------------------------------------------------------------------- asking
    def outline(self, path: str) -> str:
        """``outline``, ``get_skeleton``: of one indexed file; '' where it has none."""
        row = packets.outlines(self.symbols.filter(F.col("path") == path)).select("outline").first()
        return row.outline if row else ""

    def outline_file(self, place: str) -> str:
        """``outline`` of a file that need not be indexed."""
        text = Path(place).read_text("utf-8", "replace")
        found, _ = extract(self.spark.createDataFrame([(Path(place).name, text)], "path string, content string"))
        row = packets.outlines(found).select("outline").first()
        return row.outline if row else ""

    def symbol(self, qualified_name: str) -> DataFrame:
        """``symbol``, ``get_symbol``: all symbols of a qualified name, each with its ``body``."""
        found = self.symbols.filter(F.col("qualified_name") == qualified_name)
        bodies = symbols.symbol_bodies(found, self.files.join(found.select("path").distinct(), "path", "left_semi")).select(*symbols.KEY, "body")
        return found.join(bodies, symbols.KEY)

    def file_symbols(self, path: str) -> DataFrame:
        return symbols.reference_counts(self.symbols.filter(F.col("path") == path), self.refs).orderBy("start_line", "qualified_name")

    def file_content(self, path: str) -> str | None:
        row = self.files.filter(F.col("path") == path).select("content").first()
        return row.content if row else None

    def search(self, query: str, regex: bool = False, strict: bool = False, limit: int = 100) -> DataFrame:
        """``search``: files, symbols and lines in one table; ``semantic:`` for ranked files."""
        if query.startswith("semantic:") or not (regex or strict):
            return search.unified(self.files, self.symbols, query, limit)
        f = search.files_like(self.files, query, strict).orderBy("path").limit(limit).select(F.lit("file").alias("source"), "path", F.col("path").alias("item"), F.lit(0).alias("line"))
        s = search.symbols_like(self.symbols, query, strict).orderBy("qualified_name", "path", "start_line").limit(limit)
        g = search.grep(self.files, query, regex, strict, limit).select(F.lit("text").alias("source"), "path", F.col("content").alias("item"), "line")
        return f.unionByName(s.select(F.lit("symbol").alias("source"), "path", F.col("qualified_name").alias("item"), F.col("start_line").alias("line"))).unionByName(g)

    def grep(self, patterns: list[str]) -> DataFrame:
        return search.grep_all(self.files, patterns)

    def stats(self, prefix: str = "") -> DataFrame:
        """Counts and sums below a prefix."""
        return stats.repo_stats(self.files, self.symbols, prefix)

    def paths(self) -> DataFrame:
        """``get_map``: the indexed files."""
        return self.files.select("path").orderBy("path")

    def report(self) -> str:
        """``summarize``: the project report as Markdown."""
        rows = stats.project_report(self.files, self.symbols, self.refs).collect()
        titles = {"totals": "Totals", "types": "Most referenced types", "kinds": "Kinds", "recent": "Recently modified"}
        out = ["# Project report"]
        for section, title in titles.items():
            out += ["", f"## {title}", *[f"- {r.label}: {r.value}" for r in sorted((r for r in rows if r.section == section), key=lambda r: r.ord)]]
        return "\n".join(out)

    def map(self, budget: int = 4096, focus: str | None = None) -> str:
        """``map``: best entries within the budget, with the header's token total."""
        rows = packets.repo_map(self.symbols, self.refs, budget, focus).orderBy(F.desc("score"), "rank").collect()
        body = "\n---\n".join(r.entry for r in rows)
        return f"# Repository map (Tokens: {sum(r.tokens for r in rows)}/{budget})\n{body}"

    def pack(self, task: str, budget: int = 12000, failure: str | None = None, root: str | None = None) -> str:
        """``pack``: map (a seventh of the budget), failure lines, files that match the task in full, and their dependencies as skeletons.

        Staged files come by rank of their best hit, then path; a section that does not fit is skipped and later ones are tried. With
        ``root``, contents are read from the tree again (ST6), so that a packet is fresh although the index is not.
        """
        head = self.map(budget // 7, None)
        parts = ["# Task", task, "", head]
        if failure is not None:
            log = packets.failure_lines(read_log(self.spark, failure)).first()
            parts += ["", "## Failures", log.failures]
        files, syms, refs = self.files, self.symbols, self.refs
        hits = search.hybrid(files.select("path", "content"), task, "path", "content", EXPANDED)
        staged = [r.path for r in hits.collect()]  # EXPANDED rows at most
        stage = self.spark.createDataFrame([("task", p, i) for i, p in enumerate(staged)], "stage string, path string, place int")
        more = symbols.auto_expand(stage.select("stage", "path"), refs, syms)
        after = Window.orderBy("path")  # a packet's files
        items = stage.select(F.lit("task").alias("pack"), F.col("place").alias("pos"), "path", F.lit("file").alias("kind"), F.lit("Matches the task").alias("reason")).unionByName(
            more.select(F.lit("task").alias("pack"), (F.row_number().over(after) + len(staged)).alias("pos"), "path", F.lit("file").alias("kind"), "reason")
        )
        ahead = "\n".join(parts)
        shown = scan_repo(self.spark, root) if root is not None else files
        sections = packets.cart_sections(items, shown, packets.headed_outlines(syms))
        row = packets.rendered_carts(sections, max(1, budget - count_tokens(ahead))).first()
        body = row.text.split("\n\n", 1)[1] if row else ""
        whole = f"{ahead}\n{body}"
        return f"# Context Packet (Tokens: {count_tokens(whole)}/{budget})\n{whole}"

    def estimate(self, text: str) -> int:
        """``estimate``, ``estimate_tokens``"""
        return count_tokens(text)

    def explain(self, topic: str) -> str:
        return EXPLANATIONS.get(topic, f"Unknown topic: {topic}")

    def _linked(self, items: DataFrame, threshold: float, share: int = 1) -> DataFrame:
        """Items (``path, text``) with how many others are like them, the closest of these, and their topic."""
        from lodestone.operators.links import link_counts

        keyed = items.select(F.xxhash64("path").alias("id"), "path", "text")
        found = link_counts(keyed, keyed.filter(F.pmod("id", F.lit(share)) == 0), "id", "text", threshold)
        names = keyed.select("id", "path")
        topics = stats.main_topics(items, "path", "text")
        named = found.join(names, found["source"] == names["id"]).select("path", "links", "target", "strength")
        closest = names.select(F.col("id").alias("target"), F.col("path").alias("closest"))
        return named.join(closest, "target", "left").join(topics, "path").select("path", "links", "closest", "strength", "topic")

    def semantic_graph(self, threshold: float = 0.3, share: int = 1, whole: bool = False) -> DataFrame:
        """``get_semantic_graph``: for every file (or every ``share``-th by hash) how many files are like it, the closest, and its topic.

        Files are compared by their first 2000 characters (T20), as the graph is defined, or with ``whole`` by all of their text."""
        return self._linked(self.files.select("path", (F.col("content") if whole else content_prefix("content")).alias("text")), threshold, share)

    def pack_links(self, items: list[tuple[str, str]], threshold: float = 0.4, whole: bool = False) -> DataFrame:
        """``get_pack_semantic_links``: the same among a cart's items (path, kind): files by their text, symbols, written Symbol::path, by their body."""
        cart = self.spark.createDataFrame([("cart", i, p, k) for i, (p, k) in enumerate(items)], "pack string, pos int, path string, kind string")
        text = F.col("content") if whole else content_prefix("content")
        of_files = cart.filter("kind = 'file'").select("path").distinct().join(self.files.select("path", text.alias("text")), "path")
        held = packets.cart_symbols(cart.withColumn("kind", F.when(F.col("kind") == "file", "file").otherwise("symbol")), self.symbols)
        keys = held.select(*symbols.KEY).distinct()
        bodies = symbols.symbol_bodies(self.symbols.join(keys, symbols.KEY, "left_semi"), self.files.join(keys.select("path").distinct(), "path", "left_semi"))
        of_symbols = bodies.groupBy(F.concat("qualified_name", F.lit("::"), "path").alias("path")).agg(F.min("body").alias("text"))
        return self._linked(of_files.unionByName(of_symbols), threshold)

    # ------------------------------------------------------------------------------------------------------ user state
    def _append(self, name: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.store}/{name}")

    def _log(self, name: str, schema: str, keys: list[str]) -> DataFrame:
        """The last row of each key of an append-only log, without those removed."""
        try:
            rows = self.spark.read.schema(schema).parquet(f"{self.store}/{name}")
        except AnalysisException:  # nothing was saved yet
            rows = self.spark.createDataFrame([], schema)
        return latest(rows, keys, ["created_at"]).filter(~F.coalesce("removed", F.lit(False))).drop("removed")

    def add_favorite(self, name: str, path: str, kind: str, view_mode: str = "symbols", remove: bool = False) -> None:
        """Favourites are a log; removing one appends its end."""
        self._append("favorites", (name, path, kind, view_mode, _now(), remove), _FAVORITE)

    def favorites(self) -> DataFrame:
        """Newest first."""
        return self._log("favorites", _FAVORITE, ["name", "file_path"]).orderBy(F.desc("created_at"), "name", "file_path")

    def save_pack(self, name: str, description: str | None, items: list[tuple[str, str, str | None]], remove: bool = False) -> None:
        """A pack saved under a name takes the place of an earlier one."""
        self._append("packs", (name, description, _now(), items, remove), _PACK)

    def packs(self) -> DataFrame:
        return stats.recent_packs(self._log("packs", _PACK, ["name"]))

    def record_action(self, action: int, prompt: str, tool: str | None, kind: str, status: str, response: str | None = None, duration_ms: int = 0) -> None:
        """ST4/A11: a state of an action; its tokens are those of prompt and response."""
        used = count_tokens(f"prompt: {prompt}") + (count_tokens(response) or 0)
        self._append("actions", (action, prompt, tool, kind, used, duration_ms, status, _now(), response), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ACTIONS.fields))

    def actions(self, limit: int = 50) -> DataFrame:
        try:
            rows = self.spark.read.schema(ACTIONS).parquet(f"{self.store}/actions")
        except AnalysisException:
            rows = self.spark.createDataFrame([], ACTIONS)
        return stats.recent_actions(rows, limit)

    # -------------------------------------------------------------------------------------------------------- messages
    def handle(self, message: dict[str, Any] | str) -> dict[str, Any]:
        """One request message, also as JSON text, to one reply. A failure gives an error reply with a code: bad_json, unknown_type,
        bad_request or no_index."""
        if isinstance(message, str):
            try:
                message = json.loads(message)
            except ValueError as e:
                return {"type": "error", "code": "bad_json", "message": str(e)}
        kind = message.get("type")
        rows = lambda df: [json.loads(x) for x in df.toJSON().collect()]
        try:
            match kind:
                case "get_stats":
                    favorites = rows(self.favorites().select("name", "file_path", "kind", "view_mode"))
                    return {"type": kind, **rows(self.stats(message.get("prefix", "")))[0], "favorites": favorites, "packs": rows(self.packs().select("name", F.coalesce("description", F.lit("")).alias("description")))}
                case "get_map":
                    return {"type": kind, "results": rows(self.paths())}
                case "get_repo_map":
                    return {"type": kind, "text": self.map(int(message.get("budget", 4096)), message.get("focus"))}
                case "search":
                    return {"type": kind, "results": rows(self.search(message["query"], limit=10))}
                case "grep":
                    return {"type": kind, "results": rows(self.grep(message["patterns"]))}
                case "get_symbol":
                    return {"type": kind, "results": rows(self.symbol(message["name"]))}
                case "get_file_symbols":
                    return {"type": kind, "results": rows(self.file_symbols(message["path"]))}
                case "get_file_content" | "open_file":
                    return {"type": kind, "content": self.file_content(message["path"])}
                case "get_skeleton":
                    return {"type": kind, "text": self.outline(message["path"])}
                case "estimate_tokens":
                    return {"type": kind, "tokens": self.estimate(message["text"])}
                case "generate_summary":
                    return {"type": kind, "text": self.report()}
                case "pack_cart" | "get_pack_preview":
                    items = [("cart", i, x["path"], x.get("kind", "file"), x.get("reason")) for i, x in enumerate(message["items"])]
                    cart = self.spark.createDataFrame(items, "pack string, pos int, path string, kind string, reason string")
                    sections = packets.cart_sections(cart, self.files, packets.outlines(self.symbols)).orderBy("pos").collect()
                    return {"type": kind, "text": "".join(r.section for r in sections), "tokens": sum(r.tokens for r in sections)}
                case "get_associated_context":
                    cart = self.spark.createDataFrame([("cart", p) for p in message["paths"]], "stage string, path string")
                    return {"type": kind, "results": rows(symbols.auto_expand(cart, self.refs, self.symbols).orderBy("path"))}
                case "search_for_pack":
                    return {"type": kind, "results": rows(search.hybrid(self.files.select("path", "content"), message["query"], "path", "content", 15))}
                case "get_semantic_graph":
                    return {"type": kind, "results": rows(self.semantic_graph(float(message.get("threshold", 0.3))))}
                case "get_pack_semantic_links":
                    return {"type": kind, "results": rows(self.pack_links([(x["path"], x.get("kind", "file")) for x in message["items"]]).orderBy("path"))}
                case "get_action_history":
                    return {"type": kind, "results": rows(self.actions(int(message.get("limit", 20))))}
                case "add_favorite" | "remove_favorite":
                    self.add_favorite(message["name"], message["path"], message.get("kind", "file"), message.get("view_mode", "symbols"), kind == "remove_favorite")
                    return {"type": kind, "results": rows(self.favorites())}
                case "save_context_pack" | "delete_context_pack":
                    items = [(x["path"], x.get("kind", "file"), x.get("reason")) for x in message.get("items", [])]
                    self.save_pack(message["name"], message.get("description"), items, kind == "delete_context_pack")
                    return {"type": kind, "results": rows(self.packs().select("name", "description"))}
                case "get_pack_details":
                    return {"type": kind, "results": rows(packets.pack_items(self.packs().filter(F.col("name") == message["name"])).orderBy("pos"))}
                case "save_settings":
                    Settings(sorted(message.get("excluded", [])), sorted(message.get("included", []))).save(message["root"])
                    return {"type": kind}
                case "reindex":
                    return {"type": kind, **rows(self.index(message["root"]))[0]}
                case _:
                    return {"type": "error", "code": "unknown_type", "message": f"unknown type: {kind}"}
        except FileNotFoundError as e:
            return {"type": "error", "code": "no_index", "message": str(e)}
        except (KeyError, ValueError) as e:
            return {"type": "error", "code": "bad_request", "message": f"{type(e).__name__}: {e}"}


def history_benchmark(spark: SparkSession, snapshots: list[tuple[int, str, str, DataFrame]], budget: int = 2000, focus: str | None = None) -> DataFrame:
    """``history-benchmark``: for each (cycle, hash, message, files) the tokens of source and map, and whether the focus survives."""
    rows = []
    for cycle, commit, message, files in snapshots:  # one small job a commit
        found, refs = extract(current_files(files, ["path", "content"]))
        totals = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(token_estimate("content")), F.lit(0)).alias("t")).first()
        entries = [r.entry for r in packets.repo_map(found, refs, budget, focus).collect()]
        text = "\n---\n".join(entries)
        rows.append((cycle, commit, message, totals.n, totals.t, count_tokens(text), focus is None or focus.lower() in text.lower()))
    table = spark.createDataFrame(rows, "cycle int, hash string, message string, total_files long, naive_tokens long, map_tokens long, focus_preserved boolean")
    return stats.compression_history(table)


def repository_benchmark(spark: SparkSession, root: str, focus: str | None = None, budget: int = 2000, limit: int = 20) -> DataFrame:
    """``history-benchmark`` of a repository's last commits, each with the files that it holds."""
    history = git_history(root, limit)
    ensure_checkpoint_dir(spark)
    files = commit_files(spark, root, history, complete_options(root, None)).checkpoint()  # read once a commit below
    stamped = files.select("cycle", "path", "content", F.sha2(F.col("content").cast("binary"), 256).alias("sha256"), F.lit(None).cast("timestamp_ntz").alias("indexed_at"))
    return history_benchmark(spark, [(cycle, commit, message, stamped.filter(F.col("cycle") == cycle).drop("cycle")) for cycle, commit, message in history], budget, focus)
