"""The problems' operators on small fixtures: exact round trips, brute force, and odd inputs (nulls, empty, ties, repeats)."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.tokens import count_tokens
from lodestone.llm import budget, documentation, mixing, packing, provenance, splitting, truncation
from lodestone.llm.lexing import comment_lines, fingerprints, lex
from lodestone.schema import FILES, SYMBOLS

FILE = "path string, language string, sha256 string, indexed_at timestamp_ntz, content string"


def file_rows(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(p, None, str(n), datetime(2024, 1, 1 + n), c) for p, n, c in rows], FILE)


def symbol_rows(spark, rows):
    """(path, kind, qualified name, first line, last line, doc, tokens)"""
    return spark.createDataFrame([(p, k, q.rsplit(".", 1)[-1], q, f"func {q}()", None, None, a, b, d, t) for p, k, q, a, b, d, t in rows], SYMBOLS)


# ---------------------------------------------------------------------------------------------------------------- 1
def test_audit_finds_missing_and_wrong_estimates(spark):
    files = file_rows(spark, [("r/a.swift", 0, "old"), ("r/a.swift", 1, "func a() {\r\n}\r\n  let x = 1  \n"), ("r/e.swift", 0, None)])
    right = count_tokens("func a() {\n}")
    symbols = symbol_rows(
        spark,
        [
            ("r/a.swift", "function", "a", 1, 2, None, right),
            ("r/a.swift", "function", "b", 3, 3, None, None),
            ("r/a.swift", "function", "c", 3, 3, None, count_tokens("let x = 1")),
            ("r/a.swift", "function", "c", 3, 3, None, 99),
            ("r/a.swift", "function", "d", 7, 9, None, 0),
            ("r/e.swift", "function", "e", 1, 1, None, 5),
            ("r/none.swift", "function", "f", 1, 1, None, 0),
            (None, "function", "g", 1, 1, None, 0),
        ],
    )
    model = budget.model_for(files)
    got = {r.qualified_name: r.verdict for r in budget.audited_symbols(symbols, files, model).collect()}
    assert got["a"] == "right" and got["b"] == "missing" and got["d"] == "right" and got["f"] == "right" and "g" not in got
    assert got["c"] in ("wrong", "implausible") and got["e"] in ("wrong", "implausible")


def test_texts_of_symbols_are_measured_from_their_file(spark, monkeypatch):
    from lodestone.functions.tokens import measure
    from lodestone.llm import items
    from lodestone.llm.items import FileTexts
    from lodestone.operators import skew

    rng = random.Random(12)
    parts = ["a", "foo ", "\n", "\n\n", "  ", "\t", "\r\n", "\r", "\x0c", "\u00a0", "{", "};\n", "barbazquux", "é", "語", "😀", "12", ", "]
    for _ in range(60):
        contents = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3)]
        lines = [c.replace("\r\n", "\n").split("\n") for c in contents]
        spans = np.array([(w, rng.randint(-1, len(lines[w]) + 2), rng.randint(-1, len(lines[w]) + 2)) for w in (rng.randrange(3) for _ in range(40))])
        want = ["\n".join(lines[w][max(1, x) - 1 : y]).strip(" \t\r\n") if max(1, x) <= min(len(lines[w]), y) else "" for w, x, y in spans]
        f = FileTexts(contents)
        a, b = f.spans(*spans.T)
        assert [f.text[x:y] for x, y in zip(a, b)] == want
        assert (f.tokens(a, b) == measure(want)[:, 0]).all()
    monkeypatch.setattr(items, "CHUNK", 9)
    monkeypatch.setattr(skew, "ROWS", 7)  # one path is spread over several tasks
    files = file_rows(spark, [("r/a.swift", 0, "let a = 1\nlet bb = 2\nlet ccc = 3\n"), ("r/b.swift", 0, None)])
    rows = [("r/a.swift", None, f"q{i}", i % 4, i % 5, None, 1) for i in range(60)] + [("r/b.swift", None, "x", 1, 1, None, 0), ("r/c.swift", None, "y", 1, 1, None, 0), ("r/a.swift", None, "z", None, 2, None, 0)]
    keys = symbol_rows(spark, rows).select("path", "qualified_name", "start_line", "end_line")
    counted = items.over_symbols(keys, files, lambda f, rows, a, b: rows.assign(n=f.tokens(a, b)), "n bigint")
    text = ["let a = 1", "let bb = 2", "let ccc = 3", ""]
    assert {r.qualified_name: r.n for r in counted.collect()} == {f"q{i}": count_tokens("\n".join(text[max(1, i % 4) - 1 : i % 5]).strip()) or 0 for i in range(60)} | {"x": 0, "y": 0, "z": 0}


def test_model_predicts_held_out_texts(spark):
    rng = random.Random(3)
    words = ["alpha", "be", "gammaray", "x1", "delta_epsilon", "12", "(", ");", "\n    "]
    rows = [("file", f"r/{i}.py", "r", "py", "auth", " ".join(rng.choice(words) for _ in range(rng.randint(5, 300)))) for i in range(400)]
    items = spark.createDataFrame(rows, "kind string, key string, source string, language string, domain string, text string")
    model = budget.fit_token_model(items)
    total = budget.counted(items, model).agg(F.sum("predicted").alias("p"), F.sum("tokens").alias("t")).first()
    assert abs(total.p / total.t - 1) < 0.03


def test_budget_of_empty_tables_and_clashing_columns(spark):
    none = spark.createDataFrame([], FILES)
    model = budget.model_for(none)
    docs = spark.createDataFrame([(1, None, None, None, None, 7), (2, "a b", " EN", " Git ", "Auth", 8)], "doc_id bigint, text string, lang string, source string, domain string, tokens int")
    rows = {r.source: (r.language, r.domain, r.tokens) for r in budget.token_budget(budget.counted(budget.document_items(docs), model)).collect()}
    assert rows == {"": ("und", "", 0), "git": ("en", "auth", 3)}
    assert budget.token_budget(budget.all_counted(none, symbol_rows(spark, [("a/b", None, "q", 1, 1, None, 1)]).limit(0), docs.limit(0), model)).collect() == []


def test_areas_are_learnt_from_documents(spark):
    docs = spark.createDataFrame([(i, "x", None, None, d) for i, d in enumerate(["Ledger ", "ledger", "LEDGER", "rare", None, "", "kiosk", "kiosk", "kiosk"])], "doc_id bigint, text string, lang string, source string, domain string")
    files = file_rows(spark, [("r/src/Ledger/kiosk/a.py", 0, "a b"), ("r/rare/b.py", 0, "c"), ("ledger/c.py", 0, "d"), ("r/ledger.py", 0, "e"), ("r/LEDGER/x/d.kt", 0, None)])
    counts = budget.all_counted(files, symbol_rows(spark, [("r/LEDGER/x/d.kt", "function", "q", 1, 1, None, 3)]), docs, budget.model_for(files))
    got = {(r.kind, r.source, r.language, r.domain): (r["items"], r.tokens) for r in budget.token_budget(counts).filter("kind <> 'document'").collect()}
    assert got == {("file", "r", "py", "kiosk"): (1, 3), ("file", "r", "py", ""): (2, 2), ("file", "ledger", "py", ""): (1, 1), ("file", "r", "kotlin", "ledger"): (1, 0), ("symbol", "r", "kotlin", "ledger"): (1, 0)}


def test_pooled_model_has_all_languages_and_errors_are_reported(spark, monkeypatch):
    monkeypatch.setattr(budget, "MODELS", 1)
    rng = random.Random(8)
    rows = [(f"k{i}", "main" if i % 3 else f"odd{i}", " ".join(rng.choice(["alpha", "x1", "(", "12"]) for _ in range(rng.randint(5, 200)))) for i in range(900)]
    items = spark.createDataFrame(rows, "key string, language string, text string")
    model = budget.fit_token_model(items)
    assert set(model.coefficients) == {"main", budget.POOLED} and model.fitted[budget.POOLED] > model.fitted["main"]
    errors = {r.language: r for r in budget.model_errors(items, model).collect()}
    assert errors["main"].own_model and abs(errors["main"].total_error) < 0.05 and all(not r.own_model for n, r in errors.items() if n != "main") and len(errors) > 2


# ---------------------------------------------------------------------------------------------------------------- 2
@pytest.mark.parametrize("limit,overlap", [(4, 0), (16, 3), (50, 24), (384, 48)])
def test_pieces_cover_share_and_fit(limit, overlap):
    rng = random.Random(limit)
    parts = ["a", "foo ", "\n", "  ", "{", "}", ";\n", "barbazquux", "é", "語", ", ", ". "]
    for _ in range(150):
        text = "".join(rng.choice([*parts, "x" * rng.choice([9, 200, 3000])]) for _ in range(rng.randint(1, 120)))
        pieces = splitting.split_text(text, limit, overlap)
        assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
        for i, (a, b, t) in enumerate(pieces):
            assert count_tokens(text[a:b]) <= min(t, limit)
            if i:
                assert pieces[i - 1][0] < a <= pieces[i - 1][1] < b
                if not overlap:
                    assert a == pieces[i - 1][1]


def test_range_max_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(50):
        v = rng.integers(0, 5, rng.integers(1, 200))
        table = splitting.RangeMax(v, 64)
        for _ in range(30):
            lo = int(rng.integers(0, len(v)))
            hi = int(rng.integers(lo, len(v)))
            assert table.best(lo, hi) == lo + max(np.flatnonzero(v[lo : hi + 1] == v[lo : hi + 1].max()))


def test_code_is_cut_between_functions():
    body = "func f%d() {\n" + "    let value = other.call(1)\n" * 12 + "}\n\n"
    text = "".join(body % i for i in range(12))
    for a, _, _ in splitting.split_text(text, 300, 0)[1:]:
        assert text[a:].lstrip().startswith("func")


def test_long_lines_that_fit_go_whole_into_the_next_piece():
    text = "\n".join(["a b c d"] * 5 + ["x " * 45 + "y"] + ["a b c d"] * 5)
    for overlap in (0, 10):
        pieces = splitting.split_text(text, 110, overlap)
        assert any(text[a:b].rstrip().endswith("y") or " ".join(["x"] * 45) in text[a:b] for a, b, _ in pieces)
        assert sum("x" in text[a:b] for a, b, _ in pieces) == 1


def test_deeper_lines_are_weaker_at_any_depth():
    text = "".join(" " * n + "a = b\n" for n in (4, 8, 40, 60, 200))
    start, end, _, kind = splitting.atoms(text)
    strength = splitting.boundary_strengths(text, start, end, kind, np.zeros(len(start), dtype=bool))
    at = strength[strength > splitting.LINE // 4]
    assert len(at) >= 4 and (np.diff(at[:4]) < 0).all()


def test_split_items_keeps_columns_and_skips_small(spark):
    items = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b\n" * 50, "x"), (3, "a b\n" * 50, "x"), (4, "short", None)], "id int, text string, other string")
    rows = splitting.split_items(items, 40, 4).collect()
    assert {r.id for r in rows} == {3} and len(rows) % 2 == 0 and rows[0].other == "x"
    assert splitting.split_items(items.limit(0), 40, 4).collect() == []
    with pytest.raises(ValueError):
        splitting.split_text("a", 4, 2)


# ---------------------------------------------------------------------------------------------------------------- 3
WRITTEN = "import a\n\n" + "\n".join(f"func step{i}(x: Int) {{\n    if x > {i} {{ run{i % 7}(x) }}\n    let y = {'abcdefg'[i % 7]}.go()\n}}" for i in range(1, 4))


def reasons(path, text):
    bits, _, _ = provenance.evidence(path, text)
    return {r for i, r in enumerate(provenance.REASONS) if bits >> i & 1}


def test_single_file_evidence():
    assert reasons("r/a.swift", WRITTEN) == set()
    assert reasons("r/a.swift", "// Code generated by x 1.2. DO NOT EDIT.\n" + WRITTEN) == {"marked"}
    assert reasons("r/a.swift", WRITTEN + "\n\n// <auto-generated>\n") == {"marked"}
    assert reasons("r/a.swift", "// Writes the header 'DO NOT EDIT' into emitted files.\n" + WRITTEN) == set()
    assert reasons("r/a.swift", "// Copyright (c) the foo contributors. All rights reserved.\n" + WRITTEN) == {"notice"}
    assert reasons("r/a.swift", "// Copyright (c) r team. Internal use only.\n" + WRITTEN) == set()
    assert "packed" in reasons("r/a.js", "!function(){" + "a.push({b:1});" * 100 + "}();")
    assert "data" in reasons("r/a.swift", "let t = [\n" + "  1, 22, 333, 4,\n" * 40 + "]\n")
    assert "repetitive" in reasons("r/a.kt", "class A {\n" + "".join(f"  fun has{i}(w: Int): Int {{\n    if (w == {i}) {{\n      b[{i}] = w\n    }}\n    return b[{i}]\n  }}\n" for i in range(20)) + "}\n")
    assert reasons("r/package-lock.json", '{"lockVersion": 3, "packages": {"a": {"resolved": "x", "integrity": "y"}}}') == {"lockfile"}
    assert reasons("r/yarn.lock", "# THIS IS AN AUTOGENERATED FILE.\n# yarn lockfile v1\n\na@1:\n  version 1\n") == {"lockfile"} == reasons("r/pnpm-lock.yaml", "x: 1\n" * 400 + "lockfileVersion: '6.0'\n")
    assert reasons("r/Cargo.lock", '[[package]]\nname = "a"\nsource = "registry"\nchecksum = "f"\n') == {"lockfile"} and reasons("r/a.yaml", "key: 1\nresolved: no\n") == set()
    assert reasons("r/d.swift", "let t = [\n" + "  1, 22, 333, 4, 55555,\n" * 8 + "]\n") == {"data"} and reasons("r/d.swift", "let a = 12345678901234\nlet b = 2\n") == set()
    assert reasons("r/c.json", '{"a": 1}') == set() and reasons("r/e.swift", "") == set() and reasons("r/m.md", "Do not edit") == set()
    assert "library_folder" in reasons("r/app/node_modules/kettle/a.js", WRITTEN)
    assert reasons("r/vendor/src/main/kotlin/dev/vendor/A.kt", WRITTEN) == set() and reasons("r/web/src/vendor/kettle/a.ts", WRITTEN) == set()


def written(seed, lines=60):
    rng = random.Random(seed)
    forms = ["call{0}(x{1}, {2})", "let v{0} = {2}.go[{1}]", "if w{0} > u{1} {{ {2}() }}", "    return k{0}", "for i{0} in {2} {{", "}}", "    a{0}.b{1} += c{1} * 2"]
    return "\n".join(rng.choice(forms).format(rng.randint(0, 10**6), rng.randint(0, 10**6), rng.choice("pqrst") + str(rng.randint(0, 10**6))) for _ in range(lines))


UPSTREAM = "library string, version string, upstream_path string, language string, content string"


def provenance_of(spark, rows, upstream=()):
    """(path, day it was modified, content)"""
    from datetime import datetime

    files = spark.createDataFrame([(p, None, str(i), None, datetime(2024, 1, day) if day else None, datetime(2024, 2, 1), c) for i, (p, day, c) in enumerate(rows)], "path string, language string, sha256 string, known string, modified_at timestamp_ntz, indexed_at timestamp_ntz, content string")
    return {r.path: r.reasons for r in provenance.provenance(files, spark.createDataFrame(list(upstream), UPSTREAM)).collect()}


def test_copies_across_repositories(spark):
    shared, own, known = written("a"), written("b"), written("c")
    rows = [("r1/a.swift", 1, shared), ("r2/b.swift", 3, "// new head\n" + shared + "\nend()"), ("r5/b.swift", None, shared), ("r3/c.swift", 1, own), ("r3/d.swift", 1, own), ("r4/e.swift", 1, ""), ("r4/f.swift", 1, None), ("r4/k.swift", 1, known)]
    got = provenance_of(spark, rows, [("lib", "1", "x/y.swift", "swift", known)])
    # The original is the one that was there first; a library that is known is a copy wherever it lies.
    assert got == {"r1/a.swift": [], "r2/b.swift": ["copied"], "r5/b.swift": ["copied"], "r3/c.swift": [], "r3/d.swift": [], "r4/e.swift": [], "r4/f.swift": [], "r4/k.swift": ["copied"]}
    assert provenance_of(spark, [(*r[:2], None) for r in rows[:1]]) == {"r1/a.swift": []}


def test_forks_do_not_accuse_each_other(spark):
    rows = [(f"{repo}/{name}.kt", day, written(name)) for repo, day in (("one", 1), ("fork", 2)) for name in "abc"]
    assert set(map(tuple, provenance_of(spark, rows).values())) == {()}


def test_company_headers_are_a_repository_s_own(spark):
    header = "// Copyright (c) {} Acme Corp. All rights reserved.\n"
    rows = [(f"my-repo/Sources/F{i}.swift", 1, header.format(2020 + i) + written(i)) for i in range(4)] + [("my-repo/Sources/G.swift", 1, "// Copyright 2019 the kettle authors.\n" + written("g"))]
    got = provenance_of(spark, rows + [("solo/Add.swift", 1, header.format(2024) + written("solo"))])
    assert [p for p, r in got.items() if r] == ["my-repo/Sources/G.swift"]


def test_fingerprints_find_shared_stretches():
    rng = random.Random(2)
    tokens = [f"t{rng.randint(0, 999)}" for _ in range(300)]
    a = lex(" ".join(tokens))
    b = lex("x y z " + " ".join(tokens[100 : 100 + provenance.K + provenance.WINDOW - 1]) + " p q")
    fa, fb = (set(fingerprints(x, ~comment_lines(x, False), provenance.K, provenance.WINDOW).tolist()) for x in (a, b))
    assert fa & fb


# ---------------------------------------------------------------------------------------------------------------- 4
def test_documentation_is_found_in_files():
    swift = "/// Adds one.\n/// Fast.\n@inlinable\n\nfunc add() {}\n\n/** Block. */\nlet s = \"\"\"\n/// no\nfunc x() {}\n\"\"\"\n// plain\nfunc plain() {}\n"
    got = {(a, b): d for a, b, d in documentation.documented_lines("a.swift", swift)}
    assert got == {(3, 5): "/// Adds one.\n/// Fast.", (8, 8): "/** Block. */"}
    py = 'def a(x,\n      y):\n    """Docs."""\n\ndef b():\n    x = """no"""\n\nasync def c():\n    # note\n    \'Single.\'\n'
    assert [(a, d) for a, _, d in documentation.documented_lines("a.py", py)] == [(1, '"""Docs."""'), (8, "'Single.'")]
    assert documentation.documented_lines("a.css", "/** x */\na {}") == [(2, 2, "/** x */")] and documentation.documented("a.css", "/** x */\na {}")[0].name is None and documentation.documented_lines("a.js", "") == []
    assert [(a, b) for a, b, _ in documentation.documented_lines("a.kt", "/** Same line. */ fun f() {}\n/** Other. */\n\n@A\nfun g() {}\n")] == [(1, 1), (3, 5)]
    crlf = "/**\r\n * Two lines.\r\n */\r\nfunction f() {}\r\n"
    assert [(a, b) for a, b, _ in documentation.documented_lines("f.js", crlf)] == [(4, 4)]


@pytest.mark.parametrize(
    "doc,expected",
    [
        ("Compacts the worker.", False), ("Compacts the worker.\nThrows when it is gone.", True), ("compactWorker", False), ("TODO", False), ("/** */", False),
        ("This is the compactWorker function.", False), ("@param cache the cache\n@return the result", False), ("@param cache limit in days", True), ("{@inheritDoc}", False),
        ("- Parameter cache: <#cache description#>", False), ("-----", False), ("MARK: - Worker", False), ("Created on 1.2.2020", False), ("let worker = compactWorker(1)\nreturn worker.go()", False),
        ("Clamped to 0...9.", True), ("Compact worker, oldest first", True), ("O(n) in the number of items.", True), ("大きな要素は先に分割します。", True), ("Methode", False), ("FIXME: leaks a handle.", True),
    ],
)
def test_informative(doc, expected):
    assert documentation.informative(doc, "compactWorker", "func compactWorker(cache: String) -> Bool") is expected


def test_pairs(spark):
    files = file_rows(spark, [("r/a.swift", 0, "/// Needs a lock.\nfunc a() {}\nfunc b() {}\n")])
    rows = [("r/a.swift", None, "T.a", 2, 2, " ", 1), ("r/a.swift", "method", "T.a", 2, 2, None, 2), ("r/a.swift", "test", "T.t", 2, 2, "Needs a lock.", 1), ("r/a.swift", "function", "T.b", 3, 3, None, 1), ("r/a.swift", "fun", "T.c", 3, 3, "/// Blocks until ready.", 1), ("r/z.swift", "struct", "S", 1, 1, "A thing that lasts.", 1)]
    got = {r.qualified_name: r.documentation for r in documentation.documented_functions(symbol_rows(spark, rows), files).collect()}
    assert got == {"T.a": "Needs a lock.", "T.c": "Blocks until ready."}
    assert documentation.documented_functions(symbol_rows(spark, rows).limit(0), files).collect() == []


@pytest.mark.parametrize(
    "path,code,name,signature",
    [
        ("a.swift", "@inlinable\npublic static func add<T: Foo>(_ a: [T], b: (Int) -> Void = {}) async throws -> [T: Int] where T: X {\n}", "add", "public static func add<T: Foo>(_ a: [T], b: (Int) -> Void = {}) async throws -> [T: Int] where T: X"),
        ("a.swift", "func == (a: A, b: A) -> Bool { a }", "==", "func == (a: A, b: A) -> Bool"), ("a.swift", "init?(x: Int) {", "init", "init?(x: Int)"), ("a.swift", "var x = f(1)", None, None),
        ("a.kt", "override suspend fun <T> List<T>.foo(a: Int = 3,\n  b: String): Map<String, Int>? = x", "foo", "override suspend fun <T> List<T>.foo(a: Int = 3,\n  b: String): Map<String, Int>?"), ("a.kt", "class A(val x: Int)", None, None),
        ("A.java", "@Override\npublic <T> List<Map<String,T>> foo(int a, String... b) throws IOException {", "foo", "public <T> List<Map<String,T>> foo(int a, String... b) throws IOException"), ("A.java", "private static final Foo X = new Foo(1);", None, None),
        ("a.mjs", "export const f = async (x) => x + 1", "f", "export const f = async (x)"), ("a.ts", "private async foo<T>(a: T): Promise<T[]> {", "foo", "private async foo<T>(a: T): Promise<T[]>"), ("a.js", "const x = 3;", None, None),
        ("a.rs", "#[inline]\npub(crate) fn foo<'a, T>(x: &'a T) -> Result<T, E> {", "foo", "pub(crate) fn foo<'a, T>(x: &'a T) -> Result<T, E>"), ("a.go", "func (r *T) Foo(a int) (int, error) {", "Foo", "func (r *T) Foo(a int) (int, error)"),
        ("a.c", "static unsigned char *foo(int a, const char *b)\n{", "foo", "static unsigned char *foo(int a, const char *b)"), ("a.cpp", "std::vector<int> Foo::bar(int a) const {", "bar", "std::vector<int> Foo::bar(int a)"), ("a.zig", "pub fn foo(a: i32) i32 {", "foo", "pub fn foo(a: i32)"),
    ],
)
def test_grammars(path, code, name, signature):
    found = documentation.documented(path, "/// Waits for the lock.\n" + code)
    assert [(d.name, d.signature) for d in found] == [(name, signature)]


def test_grammar_of_python():
    got = documentation.documented("a.py", '@cached(3)\nasync def foo(a, b={}, *c) -> Dict[str, int]:\n    """Waits."""\n')
    assert [(d.name, d.signature, d.first) for d in got] == [("foo", "async def foo(a, b={}, *c) -> Dict[str, int]", 2)]


def test_pairs_without_symbols_and_boilerplate(spark):
    text = "/// Questa funzione non ha ancora una descrizione.\nfunc f{0}() {{}}\n/// Takes the lock of step {0}, then waits {1}.\nfunc g{0}() {{}}\n"
    words = ["cold", "warm", "late", "once", "twice", "long"]
    files = file_rows(spark, [(f"r/{i}.swift", 0, text.format(i, " ".join(words[i % 6 :]) + f" x{chr(97 + i % 26)}y{chr(97 + i // 26)}")) for i in range(40)] + [("r/e.rs", 0, None), ("r/x", 0, "")])
    got = documentation.extracted_functions(files).collect()
    assert {r.name for r in got} == {f"g{i}" for i in range(40)} and {r.start_line for r in got} == {4}
    assert documentation.extracted_functions(files.limit(0)).collect() == []


# ---------------------------------------------------------------------------------------------------------------- 5
def test_plan_places_every_item_once():
    rng = random.Random(4)
    for _ in range(40):
        cap = rng.choice([5, 20, 100])
        sizes = {rng.randint(1, cap): rng.randint(1, 50) for _ in range(rng.randint(1, 25))}
        plan = packing.plan_containers(sizes, cap)
        used = {}
        for pattern, times in plan:
            assert times >= 1 and sum(s * c for s, c in pattern.items()) <= cap
            for s, c in pattern.items():
                used[s] = used.get(s, 0) + c * times
        assert used == sizes
        fit = []  # first fit decreasing
        for size in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
            at = next((i for i, room in enumerate(fit) if room >= size), None)
            if at is None:
                fit.append(cap - size)
            else:
                fit[at] -= size
        assert sum(t for _, t in plan) <= 1.02 * len(fit) + 1


def test_closest_is_the_best_subset():
    from itertools import product

    rng = random.Random(9)
    for _ in range(60):
        counts = {s: rng.randint(1, 3) for s in rng.sample(range(1, 15), 4)}
        room = rng.randint(0, 30)
        got = packing._closest(room, sorted(counts, reverse=True), counts)
        assert all(0 < c <= counts[s] for s, c in got.items())
        best = max(sum(s * c for s, c in zip(counts, x)) for x in product(*[range(n + 1) for n in counts.values()]) if sum(s * c for s, c in zip(counts, x)) <= room)
        assert sum(s * c for s, c in got.items()) == best


def test_long_ids_beside_nulls_stay_exact(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "a b"), (None, "c"), (big + 2, "d " * 30)], "doc_id bigint, text string")
    assert {r.doc_id for r in packing.packed(docs, 20).collect()} == {big, None, big + 2}
    assert {r.doc_id for r in splitting.split_items(docs, 20, 0).collect()} == {big + 2}


def test_packed_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)  # many salted groups
    rows = [(i, "a " * (i % 9)) for i in range(60)] + [(100, "b " * 40), (101, None), (102, ""), (None, "c"), (7, "repeat")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, container string, tokens int")
    out = packing.packed(docs, 20).collect()
    bins = {}
    for r in out:
        bins[r.container] = bins.get(r.container, 0) + r.tokens
    assert len({(r.doc_id, r.piece, i) for i, r in enumerate(out) if r.pieces == 1}) == 64 and max(bins.values()) <= 20
    assert {r.doc_id for r in out if r.pieces > 1} == {100} and sum(r.tokens for r in out if r.doc_id == 100) == 80
    assert len(bins) == -(-sum(bins.values()) // 20)
    boxes = packing.containers(docs, 20).collect()
    assert all(b.used + b.unused == 20 and b.items == len(b.contents) for b in boxes)
    assert [r.doc_id for r in packing.split_documents(packing.containers(docs, 20)).collect()] == [100]
    blank = packing.containers(docs.withColumn("text", F.lit("")), 20).collect()
    assert sum(b.items for b in blank) == 65 and len(blank) == 4 and all(b.used == 0 for b in blank)
    assert packing.packed(docs.limit(0), 20).collect() == []


# ---------------------------------------------------------------------------------------------------------------- 6
def test_flight_keeps_sums_and_leaves_two():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 1000):
        size = rng.integers(1, 500, n).astype(float)
        p = np.full(n, 0.37)
        q = mixing.fly(p, size, np.random.default_rng(1))
        assert ((q > 0) & (q < 1)).sum() <= max(2, 0) or n < 3
        assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * size).sum() - (p * size).sum()) < 1e-4
    same = mixing.fly(np.full(9, 1 / 3), np.full(9, 5.0), np.random.default_rng(2))
    assert abs(same.sum() - 3) < 1e-9


def test_inclusion_is_unbiased():
    size = np.array([1.0, 5, 9, 20, 3, 4, 8, 2])
    hits = sum((mixing.fly(np.full(8, 0.5), size, np.random.default_rng(i)) for i in range(3000)), np.zeros(8)) / 3000
    assert np.abs(hits - 0.5).max() < 0.05


def test_large_first_is_unbiased_and_closer():
    rng = np.random.default_rng(5)
    size = np.sort(rng.integers(1, 4000, 60).astype(float))[::-1]
    p = np.full(60, 0.2)
    runs = [mixing.fly_large_first(p, size, np.random.default_rng(i)) for i in range(2000)]
    assert np.abs(sum(runs) / 2000 - 0.2).max() < 0.05 and all(((r > 0) & (r < 1)).sum() <= 2 for r in runs)
    error = [abs(float((mixing.land(r, size) * size).sum() - (p * size).sum())) for r in runs]
    assert np.mean(error) < 0.02 * (p * size).sum()


def test_mixture_reaches_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 40)
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " A " if i % 3 else "b", "w " * rng.randint(1, 30), "x") for i in range(600)] + [(900, None, None, "x"), (None, "a", "w", "x")], "doc_id bigint, source string, text string, copies string")
    targets = spark.createDataFrame([("a", 0.3, 2), ("B", 0.5, 2), ("none", 0.2, 4), ("d", None, None)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mixture_report(docs, targets).collect()}
    assert all(r.capped == r.short for r in report.values()) and all(abs(r.missed_tokens) <= 30 for r in report.values())
    assert report["none"].capped and not report["a"].capped and report["d"].mixed_tokens == 0 and not report["B"].capped
    for s in ("a", "B"):
        assert abs(report[s].mixed_tokens - report[s].wanted_tokens) < 40 and report[s].most_copies <= 2
    again = mixing.mixed(docs, targets).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in mixing.mixed(docs.repartition(7), targets).collect())
    assert mixing.mixed(docs.limit(0), targets).collect() == []


def test_mixture_in_many_levels(spark, monkeypatch):
    monkeypatch.setattr(mixing, "FLIGHT", 6)
    monkeypatch.setattr(mixing, "MOST_TARGETS", 0)  # joined by a shuffle
    docs = spark.createDataFrame([(i, "a", "w " * (1 + i % 13)) for i in range(400)] + [(900, "c", "w " * 5)], "doc_id bigint, source string, text string")
    targets = spark.createDataFrame([("a", 0.4, 1), ("c", 0.9, 2)], "source string, target_share double, max_repeats int")
    report = {r.source: r for r in mixing.mixture_report(docs, targets).collect()}
    assert abs(report["a"].missed_tokens) <= 26 and report["a"].most_copies == 1 and not report["a"].short
    assert report["c"].short and report["c"].mixed_documents == 2
    used = mixing.mixed(docs, targets).collect()
    assert len(used) == len({r.doc_id for r in used})


# ---------------------------------------------------------------------------------------------------------------- 7
def test_truncated(spark):
    nouns = ["folder", "window", "ledger", "packet", "router", "symbol"]
    full = [f"The {a} waits for the {b} until it closes. We rebuild the {b} after every {a} change." for a in nouns for b in nouns if a != b]
    rows = [(i, "s", t) for i, t in enumerate(full)]
    odd = {
        100: "The folder waits for the window until it clo", 101: "The folder waits for the window until it closes. We rebuild the", 102: "The folder waits [...]", 103: "The packet waits for the lo�",
        104: "All of the ledger rows were=\n", 105: "fn x() {\n  if (a", 106: "The folder waits for the window until it closes. �", 107: None, 108: "   ", 109: "",
        110: "The folder waits for the window until it closes.\nThanks, the crew", 111: "The window waits for the folder until it closes.\nThanks, the crew", 112: "The router waits for the folder until it closes.\nThanks, the crew", 113: "The folder waits for the window until it clo",
    }
    docs = spark.createDataFrame(rows + [(k, " S ", v) for k, v in odd.items()], "doc_id bigint, source string, text string")
    cut = {r.doc_id for r in truncation.truncated(docs).filter("cut").collect()}
    assert cut == {100, 101, 102, 103, 104, 105, 113}
    assert truncation.truncated(docs).count() == docs.count()
    assert truncation.truncated(docs.limit(0)).collect() == []


def test_cut_ends_that_repeat_are_no_closings(spark):
    nouns = ["folder", "window", "ledger", "packet", "router", "symbol", "report", "filter"]
    whole = [f"Compiling {a}\nerror: cannot find '{a}' in scope\n{b} is done.\nCheers" for a in nouns for b in nouns]
    cut = [f"Compiling {a}\nLinking {a}\nerror: cannot fin" for a in nouns[:4]]
    docs = spark.createDataFrame(list(enumerate(whole + cut)), "doc_id bigint, text string").selectExpr("doc_id", "'ci' as source", "text")
    verdicts = {r.doc_id: r.why for r in truncation.truncated(docs).filter("cut").collect()}
    assert verdicts == dict.fromkeys(range(len(whole), len(whole) + len(cut)), "prefix")


def test_long_last_lines_with_one_start_differ():
    start = "word " * 60
    keys = [truncation.ending(start + x)[0]["line"] for x in ("one", "two", "one")]
    assert keys[0] == keys[2] != keys[1]
    assert truncation.ending("a\nCheers")[0]["line"] == "Cheers"


def test_counts_of_stretches_agree_with_a_plain_count():
    texts = ["Foo bar. Baz qu\n- item one\n\n1. first thing. second\n| a | b |\n日本語。次の文", "Foo bar it. Foo bar at", "x", "a.b is c! Yes", "One\nTwo [...]", "3 ok.\n4 ok."]
    counts = truncation.Counts()
    for t in texts:
        counts.add(*truncation.ending(t))
    got = {(k, key): (a, b) for k, key, a, b in counts.rows()}
    assert got["head", "Foo bar"] == (2, 1) and got["head", "日 本"] == (1, 0) and got["head", "0 ok"] == (2, 0) and got["head", "a ."] == (1, 0)
    assert got["row", "|"] == (0, 1) and got["row", "item one"] == (0, 1) and got["row", "0 ok"] == (1, 1) and got["row", "日 本"] == (1, 0)
    assert ("row", "Two [") not in got and got["word", "Foo"][0] == 2 and ("word", "qu") in got and ("word", "Yes") not in got


def test_words_of_any_length_are_learnt(spark):
    long = "q" * 500
    docs = spark.createDataFrame([(1, f"Uses {long} here."), (2, f"Has {long} too."), (3, "It names " + long[:300]), (4, "It names nothing of that kind")], "doc_id bigint, text string").withColumn("source", F.lit(None).cast("string"))
    assert {r.doc_id: r.why for r in truncation.truncated(docs).filter("cut").collect()} == {3: "prefix"}


def test_length_and_trie_are_weighed_together():
    w = truncation.WEIGHTS
    assert w["limit"] + w["unclosed"] >= truncation.CUT > w["limit"] + w["stump"] and w["prefix"] >= truncation.CUT > w["unclosed"] + w["stump"]


def test_marks():
    assert [truncation._mark_at(x) for x in ("foo [...]", "foo (message clipped)", "foo … read more", "read more", "foo (bar)", "more", "x <br>", "I read no more", "See the rest, continue reading")] == [4, 4, 6, 0, -1, -1, -1, -1, 14]


def test_limits_of_sources(spark):
    rows = [("s", "c", n, 1) for n in range(100, 900, 7)] + [("s", "c", 500, 9), ("s", "c", 333, 3)]
    lengths = spark.createDataFrame(rows, "source string, unit string, size int, n bigint").groupBy("source", "unit", "size").agg(F.sum("n").alias("n"))
    assert [r["size"] for r in truncation.source_limits(lengths).collect()] == [500]
