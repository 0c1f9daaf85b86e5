"""Reading a source tree: walk, Gradle layout, settings and history.

The walk prunes folders; it starts on the driver and goes on, with the reading of contents, on the executors, which must see the tree.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import byte_size, content_hash, language_of, line_metrics
from lodestone.sources.ignore import ScanOptions, gitignore_rules, is_build_script

SETTINGS_FILE = ".lodestone/config.json"


@dataclass
class Settings:
    """Folders to leave out and to take in; a missing or broken file gives none."""

    excluded: list[str] = field(default_factory=list)
    included: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, root: str) -> Settings:
        try:
            raw = json.loads(Path(root, SETTINGS_FILE).read_text("utf-8"))
            return cls([str(x) for x in raw.get("excludedFolders", [])], [str(x) for x in raw.get("includedFolders", [])])
        except (OSError, ValueError, AttributeError, TypeError):
            return cls()

    def merged(self, excluded: list[str], included: list[str]) -> Settings:
        """Union, sorted."""
        return Settings(sorted({*self.excluded, *excluded}), sorted({*self.included, *included}))

    def save(self, root: str) -> None:
        target = Path(root, SETTINGS_FILE)
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps({"excludedFolders": self.excluded, "includedFolders": self.included}, indent=2), "utf-8")


@dataclass(frozen=True)
class GradleModule:
    name: str
    path: str
    source_roots: tuple[str, ...]


def _first_file(folder: Path, *names: str) -> Path | None:
    return next((folder / n for n in names if (folder / n).is_file()), None)


# How a settings script includes modules and moves their folders.
_INCLUDE = re.compile(r"\binclude\s*(?:\(([^)]*)\)|([^\n]*))")
_MODULE = re.compile(r"['\"](:[^'\"]+)['\"]")
_MOVED = re.compile(r"project\(\s*['\"](:[^'\"]+)['\"]\s*\)\.projectDir\s*=\s*file\(\s*['\"]([^'\"]+)['\"]\s*\)")


def detect_gradle(root: str) -> list[GradleModule] | None:
    """Modules of a Gradle project by name, or None where neither settings nor build file lies at the root."""
    top = Path(root).resolve()
    settings, build = _first_file(top, "settings.gradle.kts", "settings.gradle"), _first_file(top, "build.gradle.kts", "build.gradle")
    if settings is None and build is None:
        return None
    places = {":": top}
    if settings is not None:
        text = settings.read_text("utf-8", "replace")
        moved = {name: (top / where).resolve() for name, where in _MOVED.findall(text)}
        for in_parentheses, bare in _INCLUDE.findall(text):
            for name in _MODULE.findall(in_parentheses or bare):
                places[name] = moved.get(name) or top.joinpath(*[p for p in name.split(":") if p])
    else:
        places |= {f":{child.name}": child for child in top.iterdir() if child.is_dir() and _first_file(child, "build.gradle.kts", "build.gradle")}

    def roots(place: Path) -> tuple[str, ...]:
        source = place / "src"
        sets = [x for x in source.iterdir() if x.is_dir()] if source.is_dir() else []
        return tuple(sorted(str(s / lang) for s in sets for lang in ("kotlin", "java") if (s / lang).exists()))

    return [GradleModule(name, str(place), roots(place)) for name, place in sorted(places.items())]


#: Folders that the driver lists before the executors go on from them.
FOLDERS = 256


def _level(top: str, folder: str, options: ScanOptions) -> tuple[list[str], list[tuple[str, str, int, datetime]]]:
    """Subfolders to walk, relative to the top, and kept files of one folder: (relative path, place, size, modified)."""
    rel = lambda n: n if folder == "." else f"{folder}/{n}"
    try:
        entries = sorted(os.scandir(os.path.join(top, folder)), key=lambda e: e.name)
    except OSError:
        return [], []
    below, files = [], []
    for e in entries:
        if e.name.startswith("."):
            continue
        try:
            if e.is_dir():
                if not e.is_symlink() and not options.skips_folder(rel(e.name)):
                    below.append(rel(e.name))
            elif options.keeps_file(rel(e.name)):
                st = e.stat()
                files.append((rel(e.name), e.path, st.st_size, datetime.fromtimestamp(st.st_mtime, timezone.utc).replace(tzinfo=None)))
        except OSError:
            continue
    return below, files


def walk(root: str, options: ScanOptions, folder: str = ".") -> Iterator[tuple[str, str, int, datetime]]:
    """(relative path, place, size, modified) of the kept files; names that start with a dot are hidden. Errors are passed over."""
    top = os.path.realpath(root)
    todo = [folder]
    while todo:
        below, files = _level(top, todo.pop(), options)
        todo += below[::-1]
        yield from files


def complete_options(root: str, options: ScanOptions | None) -> ScanOptions:
    """Options with what the tree itself says: its settings, its root ignore file, and whether it is a Gradle project."""
    options = options or ScanOptions()
    saved = Settings.load(root)
    ignore = Path(root, ".gitignore")
    return replace(
        options, exclude=sorted({*options.exclude, *saved.excluded}), include_folders=sorted({*options.include_folders, *saved.included}),
        gitignore=gitignore_rules(ignore.read_text("utf-8", "replace")) if ignore.is_file() else [], gradle=detect_gradle(root) is not None,
    )


def scan_contents(spark: SparkSession, root: str, options: ScanOptions) -> DataFrame:
    """``path, size, modified_at, content, status`` of every kept file: ``read``, ``not_utf8`` or ``unreadable``, the latter two without content.

    The driver lists only until it knows ``FOLDERS`` folders; the executors walk on from there and read, so no list of files is ever in
    one place. They must see the tree.
    """
    top = os.path.realpath(root)
    tasks: list[tuple[str, bool]] = []
    folders = ["."]
    while folders and len(folders) + len(tasks) < FOLDERS:
        folder = folders.pop(0)
        below, _ = _level(top, folder, options)
        tasks.append((folder, False))  # its own files only
        folders += below
    tasks += [(f, True) for f in folders]
    schema = "path string, size bigint, modified_at timestamp_ntz, content string, status string"
    columns = [c.split()[0] for c in schema.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for folder, deep in zip(b["folder"], b["deep"]):
                for path, place, size, at in walk(top, options, folder) if deep else _level(top, folder, options)[1]:
                    try:
                        rows.append((path, size, at, Path(place).read_bytes().decode("utf-8"), "read"))
                    except UnicodeDecodeError:
                        rows.append((path, size, at, None, "not_utf8"))
                    except OSError:
                        rows.append((path, size, at, None, "unreadable"))
                    held += size
                    if held > 16 << 20:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=columns)

    start = spark.createDataFrame(tasks, "folder string, deep boolean").repartition(min(len(tasks), FOLDERS))
    return start.mapInPandas(read, schema)


def scan_repo(spark: SparkSession, root: str, options: ScanOptions | None = None, indexed_at: datetime | None = None) -> DataFrame:
    """A tree as a ``files`` table (R1). Settings of the tree add to the options; build scripts go unless they are wanted. Files that are
    no UTF-8 or can't be read are left out; ``scan_report`` counts them."""
    options = complete_options(root, options)
    found = scan_contents(spark, root, options).filter("status = 'read'")
    kept = found if options.include_build_scripts else found.filter(~is_build_script("path", "content"))
    m = line_metrics("content")
    return kept.select(
        "path", language_of("path").alias("language"), content_hash("content").alias("sha256"), byte_size("content").alias("size_bytes"), "modified_at",
        F.lit(indexed_at or datetime.now(timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz").alias("indexed_at"), m["doc_lines"].cast("int").alias("doc_lines"), m["code_lines"].cast("int").alias("code_lines"), "content",
    )


def scan_report(spark: SparkSession, root: str, options: ScanOptions | None = None) -> DataFrame:
    """How many files a scan read, and which it could not: ``status, files, first_path``."""
    return scan_contents(spark, root, complete_options(root, options)).groupBy("status").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log as one row ``doc_id, text``; where it can't be read, a sentence that says so."""
    try:
        text = Path(path).read_text("utf-8", "replace")
    except OSError:
        text = f"Could not read failure log: {path}"
    return spark.createDataFrame([(0, text)], "doc_id bigint, text string")


def git_history(root: str, limit: int = 20) -> list[tuple[int, str, str]]:
    """(cycle, hash, message) of the last commits, oldest first."""
    done = subprocess.run(["git", "-C", root, "log", "--format=%H|%s", "-n", str(limit)], capture_output=True, text=True, check=False)
    rows = [x.split("|", 1) for x in done.stdout.splitlines() if "|" in x]
    return [(i + 1, h, m) for i, (h, m) in enumerate(reversed(rows))]


def commit_files(spark: SparkSession, root: str, history: list[tuple[int, str, str]], options: ScanOptions | None = None) -> DataFrame:
    """The kept files of every commit as one table: ``cycle, hash, message, path, content``; contents are read from the repository by
    the executors, a commit in a task, without checking anything out."""
    options = options or ScanOptions()
    schema = "cycle int, hash string, message string, path string, content string"

    def git(*args: str) -> bytes:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, check=False).stdout

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cycle, commit, message in zip(b["cycle"], b["hash"], b["message"]):
                names = [p for p in git("ls-tree", "-r", "-z", "--name-only", commit).decode("utf-8", "replace").split("\0") if p]
                kept = [p for p in names if not any(x.startswith(".") for x in p.split("/")) and options.keeps_file(p)]
                rows = [(cycle, commit, message, p, git("show", f"{commit}:{p}").decode("utf-8", "replace")) for p in kept]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    commits = spark.createDataFrame(history, "cycle int, hash string, message string")
    return commits.repartition(max(1, len(history))).mapInPandas(read, schema)
