"""Which paths of a tree are indexed, as plain predicates for a walk and as one Catalyst expression for a table of paths."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import extension

# Extensions scanned by default, those a Gradle project adds, folders never scanned, and the path fragments that a
# Gradle project leaves out always or unless generated files are wanted.
EXTENSIONS = ("swift", "h", "m", "mm", "c", "cpp", "hpp", "js", "ts", "json", "md", "yaml", "yml", "skill", "html", "css")
GRADLE_EXTENSIONS = ("kt", "kts", "java")
DEFAULT_RULES = (".build/", ".git/", "DerivedData/", "node_modules/", ".DS_Store")
GRADLE_EXCLUDED = (".gradle/", ".idea/", ".kotlin/", "captures/", ".cxx/")
GRADLE_GENERATED = ("build/", "build/generated/", "generated/ksp/", "generated/source/", "generated/sources/", "build/tmp/")
# Script names and texts that make a .kts file a build script.
BUILD_SCRIPTS = ("build.gradle.kts", "settings.gradle.kts")
BUILD_TEXTS = ("plugins {", "dependencies {", "kotlin {")
SCRIPT_PREFIX = 4096


@dataclass(frozen=True)
class Rule:
    """One ignore rule, as a regular expression over a relative path.

    A leading slash anchors it; a trailing one asks for a folder, which a file meets only by lying below it; a star makes it a
    pattern (two stars cross folders); without slash or star it names any part of the path.
    """

    text: str

    @cached_property
    def core(self) -> str:
        return self.text.strip().strip("/") if self.text.strip() != "/" else ""

    @cached_property
    def anchored(self) -> bool:
        return self.text.strip().startswith("/") or "/" in self.core

    @cached_property
    def folder_only(self) -> bool:
        return self.text.strip().endswith("/")

    @property
    def valid(self) -> bool:
        return bool(self.core)

    def pattern(self, is_folder: bool) -> str:
        body = "".join(".*" if p == "**" else "[^/]*" if p == "*" else re.escape(p) for p in re.split(r"(\*\*|\*)", self.core))
        start = "^" if self.anchored else "^(?:.*/)?"
        base = f"{start}{body}(?:/.*)?$"
        if self.folder_only and not is_folder:  # some folder of that name must lie above the file
            literal = re.escape(self.core)
            return f"(?=^{literal}/|.*/{literal}/){base}" if "*" in self.core or self.anchored else f"^(?:.*/)?{literal}/.*$"
        return base

    def matches(self, path: str, is_folder: bool) -> bool:
        p = path.strip("/")
        return bool(p) and re.search(self.pattern(is_folder), p) is not None

    def below(self, folder: str) -> bool:
        """Whether an anchored rule lies below a folder, so that the folder must be walked."""
        return self.anchored and self.core.startswith(folder.strip("/") + "/")


def rules_of(texts: list[str] | tuple[str, ...]) -> list[Rule]:
    return [r for r in map(Rule, texts) if r.valid]


def gitignore_rules(text: str) -> list[str]:
    """Lines of a root ignore file; blank lines, comments and negations are dropped."""
    lines = (x.strip(" \t\r") for x in text.split("\n"))
    return [x for x in lines if x and x[0] not in "#!"]


@dataclass
class ScanOptions:
    include: list[str] = field(default_factory=list)  # S04: substrings, in place of the extension test
    exclude: list[str] = field(default_factory=list)
    include_folders: list[str] = field(default_factory=list)
    include_build_scripts: bool = False
    include_generated: bool = False
    gitignore: list[str] = field(default_factory=list)
    gradle: bool = False

    def extensions(self) -> tuple[str, ...]:
        """S02/S03"""
        return EXTENSIONS + (GRADLE_EXTENSIONS if self.gradle else ())

    def fragments(self) -> tuple[str, ...]:
        """S11"""
        return () if not self.gradle else GRADLE_EXCLUDED + (() if self.include_generated else GRADLE_GENERATED)

    def skips_folder(self, path: str) -> bool:
        if any(r.matches(path, True) for r in rules_of(DEFAULT_RULES) + rules_of(self.exclude)):
            return True
        inside = rules_of(self.include_folders)
        if any(r.matches(path, False) or r.matches(path, True) or r.below(path) for r in inside):
            return False
        return any(r.matches(path, True) for r in rules_of(self.gitignore))

    def keeps_file(self, path: str) -> bool:
        """Default rules, then explicit exclusion, then inclusion, then the ignore file; then fragments and extension."""
        if any(r.matches(path, False) for r in rules_of(DEFAULT_RULES) + rules_of(self.exclude)):
            return False
        included = any(r.matches(path, False) or r.matches(path, True) for r in rules_of(self.include_folders))
        if not included and any(r.matches(path, False) for r in rules_of(self.gitignore)):
            return False
        if any(f in path for f in self.fragments()):
            return False
        if self.include:
            return any(p in path for p in self.include)
        name = path.rsplit("/", 1)[-1]
        return "." in name and name.rsplit(".", 1)[-1].lower() in self.extensions()


def kept(path: Column | str, options: ScanOptions) -> Column:
    """``keeps_file`` over a column of relative paths; a null path is not kept. Parents count, as a walk would skip their folders."""
    p = F.col(path) if isinstance(path, str) else path
    any_of = lambda texts, folder: reduce(or_, [p.rlike(r.pattern(folder)) for r in rules_of(texts)], F.lit(False))
    included = any_of(options.include_folders, False) | any_of(options.include_folders, True)
    ignored = any_of(list(DEFAULT_RULES) + options.exclude, False) | (~included & any_of(options.gitignore, False))
    fragments = reduce(or_, [p.contains(f) for f in options.fragments()], F.lit(False))
    wanted = reduce(or_, [p.contains(x) for x in options.include], F.lit(False)) if options.include else extension(p).isin(*options.extensions())
    hidden = p.rlike(r"(^|/)\.[^/]")
    return F.coalesce(~ignored & ~fragments & wanted & ~hidden, F.lit(False))


def is_build_script(path: Column | str, content: Column | str) -> Column:
    """Whether a .kts file configures a build: by its name, its folder buildSrc, or what its first characters hold."""
    p, c = (F.col(x) if isinstance(x, str) else x for x in (path, content))
    head = F.substring(F.coalesce(c, F.lit("")), 1, SCRIPT_PREFIX)
    text = reduce(or_, [head.contains(t) for t in BUILD_TEXTS])
    name = F.regexp_extract(p, r"([^/]+)$", 1)
    return (extension(p) == "kts") & (name.isin(*BUILD_SCRIPTS) | p.startswith("buildSrc/") | p.contains("/buildSrc/") | text)
