"""Command line: ``python -m lodestone.cli <command>``; commands and options follow the survey's section 2.13."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import Row

from lodestone.api import Index, repository_benchmark
from lodestone.session import local_session
from lodestone.sources.ignore import ScanOptions


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--store", default=".lodestone/index", help="folder of the index tables")
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index")
    i.add_argument("path", nargs="?", default=".")
    i.add_argument("--clean", action="store_true")
    for name in ("include", "exclude", "exclude-folder", "include-folder"):
        i.add_argument(f"--{name}", action="append", default=[])
    i.add_argument("--include-build-scripts", action="store_true")
    i.add_argument("--include-generated", action="store_true")
    sub.add_parser("outline").add_argument("file")
    s = sub.add_parser("symbol")
    s.add_argument("name")
    q = sub.add_parser("search")
    q.add_argument("query")
    q.add_argument("--regex", action="store_true")
    q.add_argument("--strict", action="store_true")
    q.add_argument("--limit", type=int, default=100)
    m = sub.add_parser("map")
    m.add_argument("--budget", type=int, default=4096)
    m.add_argument("--focus")
    k = sub.add_parser("pack")
    k.add_argument("task")
    k.add_argument("--budget", type=int, default=12000)
    k.add_argument("--failure")
    k.add_argument("--output")
    e = sub.add_parser("estimate")
    e.add_argument("input", nargs="?")
    e.add_argument("--text")
    h = sub.add_parser("history-benchmark")
    h.add_argument("path", nargs="?", default=".")
    h.add_argument("--focus", default="")
    h.add_argument("--budget", type=int, default=2000)
    h.add_argument("--limit", type=int, default=20)
    h.add_argument("--output")
    sub.add_parser("explain").add_argument("topic")
    sub.add_parser("summarize")
    for one in (s, q):
        one.add_argument("--json", action="store_true")
    return p


def symbol_text(r: Row) -> str:
    """A symbol as the command shows it: its facts, then its body."""
    doc = [f"Docs: {r.doc_comment}"] if r.doc_comment else []
    return "\n".join([f"Symbol: {r.qualified_name}", f"Kind: {r.kind}", f"File: {r.path}:{r.start_line}-{r.end_line}", f"Signature: {r.signature}", *doc, f"Tokens (est): {r.estimated_tokens}", r.body, "-" * 20])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    ix = Index(local_session(), str(Path(a.store).absolute()))
    show = lambda df, as_json: print("[" + ",".join(df.toJSON().collect()) + "]" if as_json else "\n".join("\t".join(str(v) for v in r) for r in df.collect()))
    try:
        if a.command == "index":
            options = ScanOptions(a.include, a.exclude + a.exclude_folder, a.include_folder, a.include_build_scripts, a.include_generated)
            print(json.dumps(ix.index(a.path, options, a.clean, bool(a.exclude_folder or a.include_folder)).first().asDict()))
        elif a.command == "outline":
            print(ix.outline_file(a.file))
        elif a.command == "symbol":
            found = ix.symbol(a.name)
            show(found, True) if a.json else print("\n".join(symbol_text(r) for r in found.orderBy("path", "start_line").collect()) or f"No symbol found for '{a.name}'.")
        elif a.command == "history-benchmark":
            text = "[" + ",".join(repository_benchmark(ix.spark, a.path, a.focus, a.budget, a.limit).orderBy("cycle").toJSON().collect()) + "]"
            Path(a.output).write_text(text, "utf-8") if a.output else print(text)
        elif a.command == "search":
            show(ix.search(a.query, a.regex, a.strict, a.limit), a.json)
        elif a.command == "map":
            print(ix.map(a.budget, a.focus))
        elif a.command == "pack":
            text = ix.pack(a.task, a.budget, a.failure)
            Path(a.output).write_text(text, "utf-8") if a.output else print(text)
        elif a.command == "estimate":
            print(ix.estimate(a.text if a.text is not None else Path(a.input).read_text("utf-8", "replace")))
        elif a.command == "explain":
            print(ix.explain(a.topic))
        else:
            print(ix.report())
    except FileNotFoundError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
