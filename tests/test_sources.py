"""Extraction, scanning, the incremental index, streams and the command surface."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.api import Index, history_benchmark, repository_benchmark
from lodestone.cli import main as cli
from lodestone.functions.tokens import count_tokens
from lodestone.operators import extract, index
from lodestone.schema import ACTIONS, FILES
from lodestone.sources.ignore import ScanOptions, Rule, gitignore_rules, is_build_script, kept
from lodestone.sources.scan import Settings, detect_gradle, git_history, read_log, scan_repo, walk
from lodestone.streaming import incremental
from lodestone.streaming.incremental import event_windows, read_state, stream_actions, stream_files


def tree(root: Path, files: dict[str, str]) -> str:
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, "utf-8")
    return str(root)


def by_name(rows):
    return {r["qualified_name"]: r for r in rows}


# -------------------------------------------------------------------------------------------------------------- extraction
def test_swift_basics():
    text = "struct Meter {\n    let unit: String\n    func show() -> String { return unit }\n}\nfinal class Box<T>: Holder where T: Equatable {\n    private var count = 0\n    init(count: Int) { self.count = count }\n}\n"
    got = by_name(extract.swift_symbols(text, "a.swift"))
    assert set(got) == {"Meter", "Meter.unit", "Meter.show", "Box", "Box.count", "Box.init"}
    assert got["Meter.unit"]["signature"] == "let unit: String" and got["Meter.show"]["signature"] == "func show() -> String" and got["Box"]["signature"] == "class Box<T>: Holder"
    assert got["Box.count"]["access_level"] == "private" and got["Box.init"]["kind"] == "initializer" and got["Meter"]["end_line"] == 4
    refs = extract.references(text, list(got.values()))
    assert {r["context"] for r in refs if r["name"] == "unit"} == {"Meter.show"}


def uses(text, kotlin=False):
    found = (extract.kotlin_symbols if kotlin else extract.swift_symbols)(text, "a.kt" if kotlin else "a.swift")
    return [(r["name"], r["start_line"], r["context"]) for r in extract.references(text, found, kotlin)]


def test_swift_references():
    text = "import Foundation\nstruct Meter {\n    let unit: Gauge\n    func show<T: Scale>(with x: T, _ n: Int) -> String {\n        let local = make(x, at: n)\n        return local.unit.name\n    }\n    func each() { list.map { a, b in a } }\n}\n"
    got = uses(text)
    assert [n for n, line, _ in got if line == 3] == ["Gauge"] and [n for n, line, _ in got if line == 4] == ["Scale", "T", "Int", "String"]
    assert [n for n, line, _ in got if line == 5] == ["make", "x", "n"] and {c for _, line, c in got if line == 5} == {"Meter.show"}
    assert [n for n, line, _ in got if line == 6] == ["local", "unit", "unit", "name", "name"]  # a member counts as a member and as a name
    assert [n for n, line, _ in got if line == 8] == ["list", "map", "map", "a"] and not any(n == "Foundation" for n, _, _ in got)
    assert uses("") == [] and uses("// f(x)\nlet s = \"g(y)\"\n") == []


def test_kotlin_references():
    text = "package com.app\nimport a.b.Other\nclass Repo(val id: String) : Base<Item>, Closeable {\n    val cache: MutableMap<String, User> = mutableMapOf()\n    fun fetch(id: String, n: Int): User {\n        val local = User(id)\n        if (local is Admin) store.queue.push(User(id), id)\n        return local\n    }\n    fun Item.slug(): Boolean = name.trim()\n}\ndata class User(val id: String)\n"
    got = uses(text, True)
    on = lambda line: [n for n, at, _ in got if at == line]
    assert on(1) == on(2) == on(12) == [] and on(3) == ["Base", "Item", "Closeable"] and on(4) == ["MutableMap", "User", "mutableMapOf"]
    assert on(5) == ["User"] and on(6) == ["User"] and on(7) == ["Admin", "queue", "push", "User"] and on(8) == []  # once a line and context
    assert on(10) == ["Item", "trim"] and ("User", 6, "com.app.Repo.fetch") in got


def test_swift_locals_overloads_tests_and_cases():
    text = "class CaseTests {\n  func testOne() { let local = 1 }\n  func go(a: Int) {}\n  func go(b: Int) {\n    func inner() {}\n  }\n}\nenum Mode: String {\n  case on = \"x\", off(Int)\n}\nextension Mode { var raw: Int { 1 } }\n/// Doc one.\n/// Doc two.\nprotocol P: Q { func need() }\nlet top = 1\n"
    rows = extract.swift_symbols(text, "a.swift")
    names = [r["qualified_name"] for r in rows]
    assert names.count("CaseTests.go") == 2 and "CaseTests.testOne" in names and "top" not in names and not any("local" in n for n in names)
    got = by_name(rows)
    assert got["CaseTests.testOne"]["kind"] == "test" and got["CaseTests.inner"]["kind"] == "function"
    assert got["Mode.on"]["signature"] == 'case on = "x"' and got["Mode.off"]["signature"] == "case off(Int)" and got["Mode.raw"]["kind"] == "property"
    assert got["P"]["doc_comment"] == "Doc one.\nDoc two." and got["P"]["signature"] == "protocol P: Q" and got["P.need"]["enclosing_type"] == "P"


def test_scanner_survives_strings_and_comments():
    text = 'struct A {\n  let s = "struct B { \\" }"\n  /* class C { /* nested */ } */\n  let t = """\n  class D {\n  """\n  // enum E {\n  let r = #"x " y {"#\n  func f() {}\n}\nstruct Z {}\n'
    assert [r["qualified_name"] for r in extract.swift_symbols(text, "a.swift")] == ["A", "A.s", "A.t", "A.r", "A.f", "Z"]
    for broken in ("", "}", "struct", 'let s = "', "/* open", "class A {", "enum X { case", "func (", "class class class {{{"):
        extract.swift_symbols(broken, "a.swift")
        extract.kotlin_symbols(broken, "a.kt")
        extract.references(broken, [])


def test_kotlin():
    text = (
        "package com.app\n\n/**\n * Holds it.\n * Well.\n */\nsealed class Result<out T>(val code: Int, name: String) {\n    data class Ok(val value: Int) : Result<Int>(0, \"\")\n    object None\n    companion object {\n        const val MAX = 3\n    }\n"
        "    private val cache = mutableMapOf<String, Int>()\n    fun run(x: Int): Int {\n        val local = x\n        return local\n    }\n    @Test\n    fun `does it`() {}\n    constructor(a: Int) : this(a, \"\")\n}\nenum class Color { RED, GREEN(1); fun hex() = 1 }\nfun String.toSlug(): String = lowercase()\ntypealias Name = String\nconst val TOP = 1\ninterface Api\n"
    )
    rows = extract.kotlin_symbols(text, "src/main/kotlin/A.kt")
    got = by_name(rows)
    p = "com.app."
    kinds = {n.removeprefix(p): r["kind"] for n, r in got.items()}
    assert kinds == {
        "Result": "sealedClass", "Result.code": "property", "Result.Ok": "dataClass", "Result.Ok.value": "property", "Result.None": "object", "Result.Companion": "companion", "Result.Companion.MAX": "property", "Result.cache": "property",
        "Result.run": "method", "Result.does it": "test", "Result.constructor": "constructor", "Color": "enum", "Color.RED": "enumEntry", "Color.GREEN": "enumEntry", "Color.hex": "method", "toSlug": "function", "Name": "typealias", "TOP": "property", "Api": "interface",
    }
    assert got[p + "Result"]["doc_comment"] == "Holds it.\nWell." and got[p + "toSlug"]["signature"] == "fun String.toSlug(): String" and got[p + "Result.Ok"]["enclosing_type"] == "Result"
    assert got[p + "Result"]["access_level"] is None and got[p + "Result.cache"]["access_level"] == "private"
    test = by_name(extract.kotlin_symbols("class A {\n  fun testIt() {}\n}\n", "m/src/test/kotlin/A.kt"))
    assert test["A.testIt"]["kind"] == "test"


def test_line_patterns_and_fallback(spark):
    rows = [
        ("a.js", "export class Cart {}\nconst sum = (a) => a\nasync function load() {}\nlet x = 1; let y = 2\r\n"), ("a.css", "body {\n  .x { }\n#id-1{\n}\n"), ("a.py", "class A:\n    def no(self): pass\ndef yes(): pass\n"),
        ("A.java", "public class A {\n  public static List<String> names(int a) {\n"), ("d.json", "{\n}\n"), ("n.md", None), ("b.swift", "struct S {}\n"), ("e.swift", ""),
    ]
    files = spark.createDataFrame(rows, "path string, content string")
    got = {(r.path, r.name): (r.kind, r.line) for r in extract.regex_symbols(files).collect()}
    assert got == {
        ("a.js", "Cart"): ("class", 1), ("a.js", "sum"): ("function", 2), ("a.js", "load"): ("function", 3), ("a.js", "x"): ("property", 4), ("a.css", "body"): ("style", 1), ("a.css", ".x"): ("style", 2), ("a.css", "#id-1"): ("style", 3),
        ("a.py", "A"): ("class", 1), ("a.py", "yes"): ("function", 3), ("A.java", "A"): ("class", 1), ("A.java", "names"): ("method", 2),
    }
    symbols, refs = extract.extract(files)
    whole = {r.path: (r.end_line, r.estimated_tokens) for r in symbols.filter("kind = 'file'").collect()}
    assert whole == {"d.json": (3, 4), "n.md": (1, 0), "e.swift": (1, 0)}
    assert symbols.filter("path = 'b.swift'").first().qualified_name == "S" and extract.extract(files.limit(0))[0].collect() == []


# ---------------------------------------------------------------------------------------------------------------- scanning
@pytest.mark.parametrize(
    "rule,path,folder,expected",
    [
        ("node_modules/", "a/node_modules/x.js", False, True), ("node_modules/", "node_modules", True, True), ("node_modules/", "node_modules", False, False), ("/docs", "docs/a.md", False, True), ("/docs", "x/docs/a.md", False, False),
        ("*.log", "a/b.log", False, True), ("a/*.ts", "a/b.ts", False, True), ("a/*.ts", "a/c/b.ts", False, False), ("a/**", "a/c/b.ts", False, True), ("name", "x/name/y", False, True), ("na.me", "naxme", False, False), ("src/gen", "src/gen/a", False, True), ("src/gen", "x/src/gen/a", False, False),
    ],
)
def test_rules(rule, path, folder, expected):
    assert Rule(rule).matches(path, folder) is expected


def test_scan_rules_agree_with_the_column(spark, tmp_path):
    files = {n: "x" for n in ("A.swift", ".hidden.swift", "sub/.git/a.js", "Generated/G.swift", "keep/Generated/K.swift", "dist/d.js", "x.txt", "node_modules/m/i.js", "deep/er/y.YAML", "_under.md", "a*b.js")}
    root = tree(tmp_path, files)
    options = ScanOptions(exclude=["dist/"], include_folders=["keep/"], gitignore=["Generated/"])
    walked = [p for p, *_ in walk(root, options)]
    assert walked == sorted(["A.swift", "keep/Generated/K.swift", "deep/er/y.YAML", "_under.md", "a*b.js"], key=walked.index) and len(walked) == 5
    column = spark.createDataFrame([(n,) for n in files], "path string").filter(kept("path", options))
    assert {r.path for r in column.collect()} == set(walked)
    both = ScanOptions(exclude=["keep/"], include_folders=["keep/"])
    assert not both.keeps_file("keep/a.js") and ScanOptions(include=["zzz"]).keeps_file("a/zzz.bin")
    assert gitignore_rules("# c\n\n!no\n  a/ \nb\r\n") == ["a/", "b"]


def test_gradle(spark, tmp_path):
    root = tree(tmp_path, {
        "settings.gradle.kts": "include(\":app\", ':shared')\ninclude ':custom'\nproject(':custom').projectDir = file('libs/own')\n", "app/src/main/kotlin/App.kt": "class App", "app/src/test/java/T.java": "class T {}", "app/build.gradle.kts": "plugins {}",
        "libs/own/src/main/java/O.java": "class O {}", "scripts/migrate.kts": "println(1)", "buildSrc/x.kts": "val a = 1", "app/build/generated/G.kt": "class G", ".idea/a.json": "{}",
    })
    modules = {m.name: m for m in detect_gradle(root)}
    assert sorted(modules) == [":", ":app", ":custom", ":shared"] and modules[":custom"].path.endswith("libs/own")
    assert [s[len(str(tmp_path.resolve())) :] for s in modules[":app"].source_roots] == ["/app/src/main/kotlin", "/app/src/test/java"]
    paths = lambda **o: {r.path for r in scan_repo(spark, root, ScanOptions(**o)).collect()}
    assert paths() == {"app/src/main/kotlin/App.kt", "app/src/test/java/T.java", "libs/own/src/main/java/O.java", "scripts/migrate.kts"}
    assert paths(include_build_scripts=True, include_generated=True) - paths() == {"settings.gradle.kts", "app/build.gradle.kts", "buildSrc/x.kts", "app/build/generated/G.kt"}
    assert detect_gradle(str(tmp_path / "scripts")) is None
    df = spark.createDataFrame([("a.kts", None), ("a.kts", "x" * 5000 + "plugins {"), ("b.kts", "kotlin {"), ("b.kt", "plugins {")], "p string, c string")
    assert [r.b for r in df.select(is_build_script("p", "c").alias("b")).collect()] == [False, False, True, False]


def test_settings_and_logs(spark, tmp_path):
    assert Settings.load(str(tmp_path)) == Settings()
    Settings(["a"], []).merged(["c", "a"], ["b"]).save(str(tmp_path))
    assert Settings.load(str(tmp_path)) == Settings(["a", "c"], ["b"])
    (tmp_path / ".lodestone/config.json").write_text("{broken")
    assert Settings.load(str(tmp_path)) == Settings()
    assert read_log(spark, str(tmp_path / "none.log")).first().text.startswith("Could not read failure log")
    assert git_history(str(tmp_path)) == []


def test_scan_from_many_folders_and_broken_files(spark, tmp_path, monkeypatch):
    from lodestone.sources import scan

    root = tree(tmp_path, {f"a{i}/b{i % 3}/f{i}.js": f"let x = {i}" for i in range(30)} | {"_under.ts": "", "top.swift": "x", ".hid/x.js": "", "a1/.git/y.js": ""})
    (tmp_path / "bad.js").write_bytes(b"\xff\xfe\x00")
    want = {f"a{i}/b{i % 3}/f{i}.js" for i in range(30)} | {"_under.ts", "top.swift"}
    for folders in (1, 7, 1000):
        monkeypatch.setattr(scan, "FOLDERS", folders)
        assert {r.path for r in scan_repo(spark, root).collect()} == want
    assert {r.status: (r.files, r.first_path) for r in scan.scan_report(spark, root).collect()} == {"read": (32, "_under.ts"), "not_utf8": (1, "bad.js")}
    assert {p for p, *_ in walk(root, ScanOptions())} == want | {"bad.js"}
    assert scan_repo(spark, str(tmp_path / "none")).collect() == []


# ------------------------------------------------------------------------------------------------------------- index, API
SOURCES = {"src/cart.js": "export class Cart {}\nfunction total(cart) {\n  return cart.sum\n}\n", "Auth/Login.swift": "/// Signs in.\nfinal class Login {\n    func run(cart: Cart) { total(cart) }\n}\n", "style.css": ".btn {\n}\n", "data.json": "{\n}\n", ".gitignore": "Ignored/\n", "Ignored/x.js": "let a = 1\n"}


def test_incremental_index(spark, tmp_path):
    root, store = tree(tmp_path / "r", SOURCES), str(tmp_path / "s")
    ix = Index(spark, store)
    assert ix.index(root).first().asDict() == {"updated": 4, "skipped": 0, "removed": 0}
    assert {r.path for r in ix.files.collect()} == {"src/cart.js", "Auth/Login.swift", "style.css", "data.json"}
    assert ix.symbols.filter("path = 'data.json'").first().kind == "file"
    (Path(root) / "src/cart.js").write_text("function other() {}\n")
    (Path(root) / "style.css").unlink()
    assert ix.index(root).first().asDict() == {"updated": 1, "skipped": 2, "removed": 1}
    assert [r.name for r in ix.symbols.filter("path = 'src/cart.js'").collect()] == ["other"] and ix.symbols.filter("path = 'style.css'").count() == 0
    Settings(["Auth"], []).save(root)
    assert ix.index(root).first().removed == 1 and ix.refs.filter("path like 'Auth%'").count() == 0
    assert ix.index(root, clean=True).first().skipped == 0
    with pytest.raises(FileNotFoundError):
        Index(spark, str(tmp_path / "none")).files.count()


def test_only_touched_buckets_are_written(spark, tmp_path):
    root = str(tmp_path / "s")
    rows = lambda *pairs: spark.createDataFrame([(f"p{i}", "js", h, 1, None, None, 0, 0, f"class C{i} {{}}") for i, h in pairs], FILES)
    index.update_index(spark, root, rows(*[(i, "a") for i in range(60)]))
    heard = []
    index.update_index(spark, root, rows(*[(i, "b" if i == 7 else "a") for i in range(60)]), notify=lambda e, w: heard.append((e, w)))
    assert heard == [("start", {}), ("progress", {"updated": 1, "skipped": 59, "removed": 0}), ("finish", {"version": 2, "buckets": 1})]
    assert len([x for x in (tmp_path / "s/v2/files").iterdir() if x.name.startswith("_b=")]) == 1
    tables = index.read_index(spark, root)
    assert tables["files"].count() == 60 and tables["symbols"].count() == 60 and tables["files"].filter("sha256 = 'b'").count() == 1
    index.update_index(spark, root, rows((7, "c")), notify=lambda e, w: heard.append((e, w)))  # nearly all go
    assert [r.path for r in index.read_index(spark, root)["files"].collect()] == ["p7"]
    index.update_index(spark, root, rows((7, "c"), (8, "a")))
    assert not (tmp_path / "s/v1").exists() and not list((tmp_path / "s").glob(".CURRENT-*"))
    with pytest.raises(Exception):
        index.update_index(spark, root, rows((1, "a")).drop("content"), notify=lambda e, w: heard.append((e, w)))
    assert heard[-1][0] == "error" and index.read_index(spark, root)["files"].count() == 2


def test_api(spark, tmp_path):
    root, store = tree(tmp_path / "r", SOURCES), str(tmp_path / "s")
    ix = Index(spark, store)
    ix.index(root)
    assert ix.outline("Auth/Login.swift") == "/// Signs in.\nfinal class Login [L2-L4]\n  func run(cart: Cart) [L3-L3]".replace("final class", "class")
    assert {r.source for r in ix.search("cart").collect()} == {"file", "symbol", "text"} and ix.search("cart total", strict=True).filter("source = 'text'").count() == 2
    assert "Login" in ix.map(500, "sign") and "- files: 4" in ix.report() and ix.stats("src/").first().files == 1
    text = ix.pack("total of the cart", 4000)
    assert "function total(cart)" in text and text.startswith("# Context Packet (Tokens: ")
    assert ix.estimate("a b") == 3 and ix.explain("index") and "Unknown" in ix.explain("zzz")
    ask = lambda **m: ix.handle(m)
    assert ask(type="get_stats")["files"] == 4 and ask(type="get_symbol", name="Login")["results"][0]["kind"] == "class" and ask(type="nope")["type"] == "error" and ask(type="search")["type"] == "error"
    assert ask(type="get_file_content", path="style.css")["content"] == ".btn {\n}\n" and ask(type="estimate_tokens", text="a")["tokens"] == 1 and ask(type="get_skeleton", path="style.css")["text"] == ".btn { [L1-L1]"
    assert [r["path"] for r in ask(type="get_associated_context", paths=["Auth/Login.swift"])["results"]] == ["src/cart.js"]
    assert "## style.css (FULL, Directly Added)" in ask(type="pack_cart", items=[{"path": "style.css"}])["text"] and ask(type="grep", patterns=["class"])["results"]
    assert ask(type="get_file_symbols", path="src/cart.js")["results"][0]["name"] == "Cart" and [r["path"] for r in ask(type="get_map")["results"]] == ["Auth/Login.swift", "data.json", "src/cart.js", "style.css"] and ask(type="get_repo_map")["text"] and ask(type="generate_summary")["text"] and ask(type="search_for_pack", query="cart")["results"]
    assert ix.semantic_graph().count() == 4 and {r.topic for r in ix.semantic_graph(0.0, whole=True).filter("path = 'data.json'").collect()} == {"General"}
    linked = ask(type="get_pack_semantic_links", items=[{"path": "src/cart.js"}, {"path": "total::src/cart.js", "kind": "symbol"}, {"path": "style.css"}, {"path": "gone.js"}])["results"]
    assert [(r["path"], r["links"], r.get("closest")) for r in linked] == [("src/cart.js", 1, "total::src/cart.js"), ("style.css", 0, None), ("total::src/cart.js", 1, "src/cart.js")]
    assert ix.favorites().collect() == [] and ix.packs().collect() == [] and ix.actions().collect() == []
    ask(type="add_favorite", name="A", path="p")
    assert [r["name"] for r in ask(type="add_favorite", name="B", path="p")["results"]] == ["B", "A"] and [r["name"] for r in ask(type="remove_favorite", name="A", path="p")["results"]] == ["B"]
    ask(type="save_context_pack", name="one", items=[{"path": "x"}])
    assert [r["name"] for r in ask(type="get_stats")["favorites"]] == ["B"] and ask(type="get_stats")["packs"] == [{"name": "one", "description": ""}]
    ask(type="save_context_pack", name="one", description="again", items=[{"path": "style.css"}, {"path": "y"}])
    assert [r["path"] for r in ask(type="get_pack_details", name="one")["results"]] == ["style.css", "y"] and ask(type="delete_context_pack", name="one")["results"] == []
    ix.record_action(1, "p", "map", "cli", "pending")
    ix.record_action(1, "p", "map", "cli", "completed", "a b", 7)
    assert [(r["status"], r["tokens_used"]) for r in ask(type="get_action_history")["results"]] == [("completed", count_tokens("prompt: p") + 3)]
    assert ix.handle("{")["code"] == "bad_json" and Index(spark, str(tmp_path / "no")).handle({"type": "get_map"})["code"] == "no_index"
    (Path(root) / "src/cart.js").write_text("function total(cart) { return 42 }\n")
    assert "42" in ix.pack("total cart", 4000, root=root) and "42" not in ix.pack("total cart", 4000)
    ask(type="save_settings", root=root, excluded=["Auth"])
    assert Settings.load(root).excluded == ["Auth"]
    files = ix.files
    h = history_benchmark(spark, [(1, "h1", "one", files.filter("path = 'style.css'")), (2, "h2", "two", files)], 500, "cart")
    assert [(r.cycle, r.total_files, r.focus_preserved) for r in h.orderBy("cycle").collect()] == [(1, 1, False), (2, 4, True)]


def test_history_of_a_repository(spark, tmp_path, capsys):
    import subprocess

    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.email=a@b", "-c", "user.name=n", *a], check=True, capture_output=True)
    git("init", "-q")
    for n, files in enumerate([{"a.swift": "class A {\n  func cartTotal() {}\n}\n"}, {"b.swift": "struct B {}\n", ".hid.swift": "x"}]):
        tree(tmp_path, files)
        git("add", "-A")
        git("commit", "-qm", f"commit {n}")
    rows = repository_benchmark(spark, str(tmp_path), "carttotal").orderBy("cycle").collect()
    assert [(r.cycle, r.message, r.total_files, r.focus_preserved) for r in rows] == [(1, "commit 0", 1, True), (2, "commit 1", 2, True)] and rows[1].naive_tokens > rows[0].naive_tokens
    assert cli(["history-benchmark", str(tmp_path), "--limit", "1", "--output", str(tmp_path / "o.json")]) == 0
    assert [r["total_files"] for r in json.loads((tmp_path / "o.json").read_text())] == [2]


def test_tools(tmp_path):
    from lodestone import tools

    assert tools.run(["explain", "index"], str(tmp_path / "none"))["error"] == "bad_repo" and tools.run(["explain", "x"], str(tmp_path), python=str(tmp_path / "nope"))["error"] == "not_found"
    assert tools.run(["explain", "x"], str(tmp_path), timeout=0.01)["error"] == "timeout" and tools.run(["nonsense"], str(tmp_path))["error"] == "failed"
    assert tools._options(clean=True, include=["a", "b"], focus=None, strict=False, limit=3) == ["--clean", "--include", "a", "--include", "b", "--limit", "3"]
    assert tools.summarize(str(tmp_path))["error"] == "no_index" and len(tools.TOOLS) == 9


def test_command_line(spark, tmp_path, capsys):
    root, store = tree(tmp_path / "r", SOURCES), str(tmp_path / "s")
    assert cli(["--store", store, "report" if False else "summarize"]) == 1
    assert cli(["--store", store, "index", root]) == 0 and cli(["--store", store, "symbol", "Login", "--json"]) == 0
    assert cli(["--store", store, "symbol", "Login"]) == 0 and cli(["--store", store, "symbol", "Nobody"]) == 0
    out = capsys.readouterr().out.strip().splitlines()
    assert "Symbol: Login" in out and "    func run(cart: Cart) { total(cart) }" in out and "No symbol found for 'Nobody'." in out and "func run" in json.loads(out[1])[0]["body"]
    assert json.loads(out[0])["updated"] == 4 and json.loads(out[1])[0]["name"] == "Login"
    assert cli(["--store", store, "pack", "cart", "--output", str(tmp_path / "o.md")]) == 0 and "Context Packet" in (tmp_path / "o.md").read_text()
    for argv in (["search", "cart"], ["map", "--budget", "300"], ["estimate", "--text", "a b"], ["explain", "pack"], ["outline", f"{root}/Auth/Login.swift"]):
        assert cli(["--store", store, *argv]) == 0
    assert "class Login [L2-L4]" in capsys.readouterr().out


# ----------------------------------------------------------------------------------------------------------------- streams
def test_tables(spark, tmp_path):
    from lodestone.sources.tables import read_table, to_json_lines, write_table, write_text

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for form in ("parquet", "orc", "json", "csv"):
        write_table(df, str(tmp_path / form), form)
        assert sorted(map(str, read_table(spark, str(tmp_path / form), form, "k int, v string").collect())) == sorted(map(str, df.collect()))
    write_table(df, str(tmp_path / "by"), partition_by=("k",))
    assert (tmp_path / "by/k=1").is_dir() and [r.value for r in to_json_lines(df.filter("k = 1")).collect()] == ['{"k":1,"v":"a"}']
    write_text("x", str(tmp_path / "d/o.md"))
    with pytest.raises(ValueError):
        read_table(spark, "x", "avro")


def test_streams(spark, tmp_path):
    t = lambda n: datetime(2024, 1, n)
    row = lambda p, n, c: (p, "js", str(n), 1, None, t(n), 0, 0, c)
    source, store, seen = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.createDataFrame([row("a", 1, "one"), row("b", 1, "b")], FILES).write.mode("append").parquet(source)
    run = lambda: stream_files(spark, source, store, str(tmp_path / "cp"), lambda e, n: seen.append((e, n))).awaitTermination(60)
    assert run()
    spark.createDataFrame([row("a", 3, "three"), row("a", 2, "late")], FILES).write.mode("append").parquet(source)
    assert run()
    assert {r.path: r.content for r in read_state(spark, store, "files").collect()} == {"a": "three", "b": "b"}
    assert seen == [(e, n) for n in (0, 1) for e in ("start", "progress", "finish")]
    batch = spark.createDataFrame([row("a", 9, "nine")], FILES)
    merge = incremental._merge(store, "files", lambda df: df, lambda e, n: seen.append((e, n)))
    merge(batch, 1)  # repeated: nothing changes
    with pytest.raises(RuntimeError):
        merge(batch, 7)
    assert seen[-4:] == [("start", 1), ("finish", 1), ("start", 7), ("error", 7)] and read_state(spark, store, "files").filter("content = 'nine'").count() == 0
    spark.createDataFrame([(1, "p", None, "cli", 0, 0, "completed", t(2), "r"), (1, "p", None, "cli", 0, 0, "pending", t(1), None)], ACTIONS).write.parquet(str(tmp_path / "a"))
    assert stream_actions(spark, str(tmp_path / "a"), str(tmp_path / "ao"), str(tmp_path / "acp")).awaitTermination(60)
    assert [r.status for r in read_state(spark, f"{tmp_path}/ao", "actions").collect()] == ["completed"]


def test_event_windows(spark):
    e = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 59), "x", 1.0), (2, datetime(2024, 1, 1, 1, 0), "x", 2.0), (3, None, "x", 3.0)], "event_id bigint, ts timestamp_ntz, event_type string, value double")
    assert [(r.start.hour, r.events) for r in event_windows(e).orderBy("start").collect()] == [(0, 1), (1, 1)]


# ---------------------------------------------------------------------------------------------------------------- registry
def test_every_query_has_a_name_and_sql_fits():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60
