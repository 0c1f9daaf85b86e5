"""Core operators on small fixtures: scalar functions, views, joins, search, packets, links."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.tokens import atoms, count_tokens, counter_udf, measure, measures, token_estimate
from lodestone.operators import index, links, packets, search, stats, symbols
from lodestone.operators.current import among_current, current_files, latest
from lodestone.schema import ACTIONS, FILES, SYMBOLS

SYMBOL = "path string, kind string, name string, qualified_name string, signature string, enclosing_type string, access_level string, start_line int, end_line int, doc_comment string, estimated_tokens int"


def sym(path, kind, qn, a, b, sig=None, access=None, doc=None, enclosing=None):
    return (path, kind, qn.rsplit(".", 1)[-1], qn, sig or f"{kind} {qn}", enclosing, access, a, b, doc, 1)


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("x")).first().x


# --------------------------------------------------------------------------------------------------------------- tokens
@pytest.mark.parametrize(
    "text,tokens",
    [("", 0), (None, None), ("é", 1), ("語語", 1), ("abcdefg", 1), ("abcdefgh", 3), ("abcdefghijk", 3), ("abcdefghijkl", 4), ("a b", 3), ("a\n\n  b", 5), ("  \n  a", 2), ("a(b);", 5), ("a　 b", 3), ("�", 1), ("a_b", 3)],
)
def test_token_estimate(spark, text, tokens):
    assert one(spark, text, token_estimate("t")) == tokens
    assert count_tokens(text) == tokens


@given(st.text(alphabet="ab1 \n\t\r　é語.$=_�\x0b😀abcdefgh", max_size=80))
@settings(max_examples=300, deadline=None)
def test_atoms_are_a_partition_of_tokens(text):
    start, end, cost, _ = atoms(text)
    assert (start[1:] >= end[:-1]).all() and (end > start).all()
    assert count_tokens(text) == (max(1, int(cost.sum())) if text else 0)
    assert measure([text, "", text])[:, 0].tolist() == [count_tokens(text), 0, count_tokens(text)]


def test_measures_and_own_counter(spark):
    df = spark.createDataFrame([("aé語 12,",), (None,), ("",)], "t string")
    rows = [r.m for r in df.select(measures("t").alias("m")).collect()]
    assert list(rows[0]) == [4, 10, 2, 2, 1, 1, 1, 1] and list(rows[1]) == list(rows[2]) == [0] * 8
    assert [r.n for r in df.select(counter_udf(len)("t").alias("n")).collect()] == [7, None, 0]


# ------------------------------------------------------------------------------------------------------------------ text
def test_lines(spark):
    assert one(spark, "a\r\nb", T.split_lines("t")) == ["a", "", "b"]
    assert one(spark, "a b\u0085c", T.split_lines("t")) == ["a", "b", "c"]
    assert one(spark, "a\r\nb\n", T.source_lines("t")) == ["a", "b", ""]
    m = one(spark, "// doc\n\n  /* x */\n 　\ncode // no\n\t//more", T.line_metrics("t"))
    assert (m.doc_lines, m.code_lines) == (2, 2)


@pytest.mark.parametrize("a,b,body", [(1, 1, "x"), (2, 9, "y\nz"), (0, 2, "x\ny"), (4, 5, ""), (3, 2, "")])
def test_body_by_range(spark, a, b, body):
    assert one(spark, "x\ny\nz", T.body_by_range("t", F.lit(a), F.lit(b))) == body


@pytest.mark.parametrize("path,language,fence", [("a/B.swift", "swift", "swift"), ("x.KTS", "kotlin", "kotlin"), ("a.b/noext", "", ""), ("m.md", "md", "markdown"), ("s.scss", "scss", ""), ("a.js", "js", "javascript")])
def test_language(spark, path, language, fence):
    assert one(spark, path, T.language_of("t")) == language and one(spark, path, T.fence_of("t")) == fence


def test_small_functions(spark):
    assert one(spark, " `x y` ", T.clean_identifier("t")) == "x y"
    assert one(spark, "<a & 'b'>", T.html_escape("t")) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert one(spark, "Sources/App/x/M.swift", T.module_title("t")) == "App / M.swift"
    assert one(spark, "Alpha beta beta", T.complexity("t")) == pytest.approx(10 * 2 / 3 + 15 / 5000)
    assert one(spark, "a", T.cosine(F.array(F.lit(1), F.lit(0)), F.array(F.lit(1), F.lit(1)))) == pytest.approx(0.5**0.5)
    assert one(spark, "a", T.cosine(F.array(F.lit(1)), F.array(F.lit(1), F.lit(1)))) == 0.0


def test_topics_and_failures(spark):
    docs = spark.createDataFrame([(1, "alpha beta Beta func"), (2, "beta alpha"), (3, "the and"), (4, None)], "doc_id int, text string")
    assert {r.doc_id: r.topic for r in stats.main_topics(docs).collect()} == {1: "beta", 2: "alpha", 3: "General", 4: "General"}
    logs = spark.createDataFrame([(1, "ok\nError: x\ntest Failed"), (2, "fine"), (3, None)], "doc_id int, text string")
    got = {r.doc_id: r.failures for r in packets.failure_lines(logs).collect()}
    assert got[1] == "Error: x\ntest Failed" and got[2] == got[3] == packets.NO_FAILURE


# ---------------------------------------------------------------------------------------------------------------- current
def test_current_rows(spark):
    t = lambda n: datetime(2024, 1, n)
    rows = [("a", None, "h1", 1, None, t(1), 0, 0, "old"), ("a", None, "h2", 1, None, t(3), 0, 0, "new"), ("a", None, "h2", 1, None, t(3), 0, 0, "new"), ("a", None, "h3", 1, None, t(2), 0, 0, "late"), ("b", None, None, None, None, None, None, None, None), (None, None, "x", 1, None, t(1), 0, 0, "x")]
    files = spark.createDataFrame(rows, FILES)
    assert {r.path: r.content for r in current_files(files).collect()} == {"a": "new", "b": None}
    assert current_files(files.limit(0)).collect() == []
    assert {r.path: r.content for r in among_current(files.filter("coalesce(content, 'x') <> 'late'"), files).collect()} == {"a": "new", "b": None}
    assert among_current(files.filter("content = 'old'"), files).collect() == []
    two = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c")], "k int, o int, v string")
    assert {r.k: r.v for r in latest(two, ["k"], ["o"]).collect()} == {1: "b", None: "c"}


def test_latest_actions(spark):
    t = lambda n: datetime(2024, 1, n)
    rows = [(1, "p", None, "cli", 0, 0, "pending", t(1), None), (1, "p", None, "cli", 5, 9, "completed", t(2), "r"), (1, "p", None, "cli", 0, 0, "pending", t(1), None), (2, "q", "map", "web", 0, 0, "pending", t(3), None), (2, "q", "map", "web", 1, 1, "failed", t(3), None), (3, None, None, None, None, None, None, None, None)]
    a = spark.createDataFrame(rows, ACTIONS)
    assert {r.id: r.status for r in stats.latest_actions(a).collect()} == {1: "completed", 2: "failed", 3: None}
    assert [r.id for r in stats.recent_actions(a, 2).collect()] == [2, 1]
    costs = {(r.tool, r.status): (r.recorded_tokens, r.estimated_tokens) for r in stats.action_costs(a).collect()}
    assert costs[("", "completed")] == (5, count_tokens("prompt: p") + 1) and costs[("", None)] == (0, count_tokens("prompt: "))


# ---------------------------------------------------------------------------------------------------------------- symbols
def test_symbol_joins(spark):
    s = spark.createDataFrame([sym("a.js", "class", "A", 1, 9), sym("b.js", "class", "A", 1, 5), sym("a.js", "function", "A.f", 2, 4), sym("a.js", "weird", "A.g", 5, 6), sym("a.js", "weird", "A.g", 5, 6)], SYMBOL)
    u = symbols.unique_symbols(s)
    assert u.count() == 4 and u.filter("qualified_name = 'A.g'").first().kind == "function"
    refs = spark.createDataFrame([("a.js", "A", 3, 3, None), ("a.js", "A", 3, 3, None), ("c.js", "A", 1, 1, "x"), ("a.js", "f", 8, 8, None), ("c.js", "zz", 1, 1, None), ("c.js", None, 1, 1, None)], "path string, name string, start_line int, end_line int, context string")
    assert {r.name: (r.references, r.definitions, r.joined) for r in symbols.definitions_referenced(u, refs).collect()} == {"A": (3, 2, 6), "f": (1, 1, 1)}
    assert {(r.path, r.qualified_name): r.ref_count for r in symbols.reference_counts(u, refs).collect()} == {("a.js", "A"): 3, ("b.js", "A"): 3, ("a.js", "A.f"): 1, ("a.js", "A.g"): 0}
    assert [r.qualified_name for r in symbols.unused_symbols(u, refs).collect()] == ["A.g"]
    assert [(r.name, r["count"]) for r in symbols.top_referenced(u, refs).collect()] == [("A", 6)]
    got = {(r.path, r.name, r.start_line): (r.references, r.context) for r in symbols.enclosing_symbol(refs, u).collect()}
    assert got[("a.js", "A", 3)] == (2, "A.f") and got[("a.js", "f", 8)] == (1, "A") and got[("c.js", "A", 1)] == (1, None)
    assert {r.qualified_name: r.containers for r in symbols.enclosing_types(u).filter("path = 'a.js'").collect()} == {"A": "", "A.f": "A", "A.g": "A"}
    staged = spark.createDataFrame([("s", "c.js"), ("s", "b.js")], "stage string, path string")
    assert [(r.path, r.reason) for r in symbols.dependency_crawl(staged, refs, u).orderBy("path").collect()] == [("a.js", "Defines A"), ("b.js", "Defines A")]
    assert [r.path for r in symbols.auto_expand(staged, refs, u).collect()] == ["a.js"]
    hits = spark.createDataFrame([("A", 1.0), ("gone", 2.0)], "qualified_name string, score double")
    assert [(r.qualified_name, r.path) for r in symbols.live_symbols(hits, u).collect()] == [("A", "a.js")]


def test_equal_spans_take_the_longest_name(spark):
    s = spark.createDataFrame([sym("a", "class", "A", 1, 3), sym("a", "class", "A.Bc", 1, 3), sym("a", "class", "A.Bd", 1, 3)], SYMBOL)
    refs = spark.createDataFrame([("a", "x", 2, 2, None), ("a", "y", 2, 9, None)], "path string, name string, start_line int, end_line int, context string")
    assert {r.name: r.context for r in symbols.enclosing_symbol(refs, s).collect()} == {"x": "A.Bc", "y": None}


# ----------------------------------------------------------------------------------------------------------------- search
CORPUS = [("a/User.swift", "class User {\n  let name = 1\n}\n"), ("a/Base.swift", "Error 100%\nuser_name\n"), ("b/x.md", "User and\nname\n"), ("b/none.md", None), ("b/e.md", "")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(CORPUS, "path string, content string").cache()


def test_like(spark, corpus):
    assert {r.path for r in search.files_like(corpus, "user BASE").collect()} == {"a/User.swift", "a/Base.swift"}
    assert {r.path for r in search.files_like(corpus, "user a/", strict=True).collect()} == {"a/User.swift"}
    assert {r.path for r in search.files_like(corpus, "u_er").collect()} == {"a/User.swift"}
    assert search.files_like(corpus, " ").collect() == []


def test_grep(corpus):
    rows = {r.path: r for r in search.grep(corpus, "name").collect()}
    assert rows["a/User.swift"].line == 2 and rows["a/User.swift"].snippet == "  L1: class User {\n> L2:   let name = 1\n  L3: }"
    assert {r.path for r in search.grep(corpus, "user name", strict=True).collect()} == {"a/Base.swift"}  # on one line, not in one file
    assert {r.path for r in search.grep(corpus, "100%").collect()} == {"a/Base.swift"}
    assert search.grep(corpus, "([", regex=True).collect() == [] and search.grep(corpus, "").collect() == []
    assert {r.path for r in search.grep(corpus, "^user", regex=True).collect()} == {"a/Base.swift", "b/x.md"}
    assert [r.path for r in search.grep(corpus, "e", limit=2).collect()] == ["a/Base.swift", "a/User.swift"]
    assert {r.path for r in search.text_search(corpus, "let name").collect()} == {"a/User.swift"}


def test_grep_all_flags_what_it_leaves_out(spark):
    many = spark.createDataFrame([("p", "x\n" * 30)], "path string, content string")
    rows = search.grep_all(many, ["x", "(["], most=20).collect()
    assert len(rows) == 20 and all(r.truncated for r in rows)
    assert not any(r.truncated for r in search.grep_all(many, ["x"], most=30).collect())


PATTERNS = [r"\Aclass", "^class", "end$", r"x(?!\s)", "a++b", "[^q]+z", r"foo\b", r"\w+\(", "(?:ab|cd)", r"[$^]", "a.b", r"\Bo", "(?<!y)x", r"z\Z"]


def test_the_test_of_a_whole_content_loses_no_line(spark):
    texts = ["x\nclass Foo", "a\x0bclass B", "end\nmore", "x\u0085y", "aab\nfoo\x0cz", "f(1)\r\nx", "cd", "$\n^", "a\nb", "a.b z", "foo\u2028bar x", "yx\nxz", ""]
    files = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)] + [("n", None)], "path string, content string").cache()
    for p in PATTERNS:
        lines = files.select("path", F.explode(T.split_lines("content")).alias("l"))
        every = {r.path for r in lines.filter(F.col("l").rlike(f"(?i){p}")).collect()}
        assert {r.path for r in search.grep(files, p, regex=True).collect()} == every, p
        assert {r.path for r in search.grep_all(files, [p]).collect()} == {r.path for r in lines.filter(F.col("l").rlike(p)).collect()}, p
    assert [search.matches_across_lines(p) for p in PATTERNS] == [False, False, False, False, False, True, True, True, True, True, True, True, False, False]


TERMS = ["user", "name", "class", "and", "error", "let"]


@given(st.lists(st.sampled_from(TERMS), min_size=1, max_size=3))
@settings(max_examples=12, deadline=None)
def test_all_terms_find_no_more_than_any(corpus, terms):
    q = " ".join(terms)
    assert {r.path for r in search.grep(corpus, q, strict=True).collect()} <= {r.path for r in search.grep(corpus, q).collect()}


def test_ranked(spark, corpus):
    docs = spark.createDataFrame([(1, "lock the ledger"), (2, "ledger ledger ledger"), (3, "other words here"), (4, None)], "doc_id int, text string")
    assert [r.doc_id for r in search.bm25(docs, "ledger").collect()] == [2, 1]
    assert [r.doc_id for r in search.proxy_similarity(docs, "ledger").collect()] == [2, 1]
    assert [r.doc_id for r in search.hybrid(docs, "ledger").collect()] == [2, 1]
    assert search.bm25(docs, "...").collect() == [] and search.hybrid(docs.limit(0), "ledger").collect() == []
    syms = spark.createDataFrame([sym("a/User.swift", "class", "User", 1, 3)], SYMBOL)
    assert {r.source for r in search.unified(corpus, syms, "user").collect()} == {"file", "symbol", "text"}
    assert {r.source for r in search.unified(corpus, syms, "semantic: user name").collect()} == {"semantic"}


# ---------------------------------------------------------------------------------------------------------------- packets
def test_fold_skips_and_goes_on(spark):
    rows = spark.createDataFrame([("g", 1, 60), ("g", 2, 50), ("g", 3, 30), ("g", 4, 10), ("h", 1, 100), ("h", 2, 99)], "g string, o int, cost int")
    got = {(r.g, r.o): (r.taken, r.used) for r in packets.fold_to_budget(rows, "g", ["o"], "cost", 100).collect()}
    assert got == {("g", 1): (True, 60), ("g", 2): (False, 60), ("g", 3): (True, 90), ("g", 4): (False, 90), ("h", 1): (False, 0), ("h", 2): (True, 99)}
    assert packets.fold_to_budget(rows.limit(0), "g", ["o"], "cost", 100).collect() == []


def test_map(spark):
    rows = [sym("s/User.swift", "class", "User", 1, 9, "class User"), sym("s/Login.swift", "function", "Login.run", 1, 2, "func run()", "private", "Starts a user session."), sym("s/UserTests.swift", "class", "UserTests", 1, 2), sym("s/Hidden.swift", "function", "h", 1, 1, "func h()", "private"), sym("s/Pub.swift", "function", "p", 1, 1, "func p()", "public")]
    s = spark.createDataFrame(rows, SYMBOL)
    refs = spark.createDataFrame([("x", "User", 1, 1, None)] * 3, "path string, name string, start_line int, end_line int, context string")
    assert {r.name for r in packets.map_candidates(s).collect()} == {"User", "p"}
    focus = {r.name: r.matches_focus for r in packets.map_candidates(s, "session zzz").collect()}
    assert focus == {"User": False, "run": True}
    entries = [r.entry for r in packets.repo_map(s, refs, 200, "session").orderBy("rank").collect()]
    assert entries == ["/// Starts a user session.\nLogin.swift: func run() [L1-L2]", "class User [L1-L9]"]
    assert packets.repo_map(s, refs, 8).collect() == [] and packets.repo_map(s.limit(0), refs, 100).collect() == []
    both = packets.focus_entries(packets.map_entries(symbols.reference_counts(packets.map_candidates(s, "session"), refs)))
    assert both.filter("entry like 'FOCUS: %'").count() == 1


def test_map_looks_at_ties_behind_the_first_entries(spark):
    long = " ".join(f"word{i}" for i in range(30))
    s = spark.createDataFrame([*[sym(f"a/F{i:02}.swift", "class", f"C{i}", 1, 2, f"class C{i}: {long}") for i in range(45)], sym("b/Z.swift", "class", "Z", 1, 2, "class Z")], SYMBOL)
    refs = spark.createDataFrame([], "path string, name string, start_line int, end_line int, context string")
    assert [(r.rank, r.entry) for r in packets.repo_map(s, refs, 20).collect()] == [(46, "class Z [L1-L2]")]


@pytest.mark.parametrize("budget", [9, 23, 60, 200])
def test_map_against_brute_force(spark, budget):
    import random

    rng = random.Random(budget)
    rows = [sym(f"a/F{i % 17}.swift", "class", f"C{i}", i % 5, i % 5 + 2, f"class C{i} " + "word " * rng.choice([0, 0, 1, 3, 9, 40])) for i in range(150)]
    s = spark.createDataFrame(rows, SYMBOL)
    refs = spark.createDataFrame([("x", f"C{i % 30}", 1, 1, None) for i in range(90)], "path string, name string, start_line int, end_line int, context string")
    entries = packets.map_entries(symbols.reference_counts(packets.map_candidates(s), refs)).withColumn("score", packets.map_score()).collect()
    used, want = 0, []
    for rank, e in enumerate(sorted(entries, key=lambda e: (-e.score, e.path, e.start_line, e.entry)), 1):
        if used + count_tokens(e.entry) < budget:
            used += count_tokens(e.entry)
            want.append((rank, e.entry))
    assert sorted((r["rank"], r["entry"]) for r in packets.repo_map(s, refs, budget).collect()) == want


def test_map_of_many_symbols_is_half_the_source(spark):
    body = "\n".join(f"    func filler{i}() {{ let value{i} = other{i}.call({i}, {i + 1}); print(value{i}) }}" for i in range(100))
    s = spark.createDataFrame([sym("A.swift", "class", "A", 1, 102, "class A"), sym("B.swift", "class", "B", 1, 102, "class B"), *[sym("A.swift", "function", f"A.filler{i}", i + 2, i + 2, f"func filler{i}()", "private") for i in range(100)]], SYMBOL)
    refs = spark.createDataFrame([], "path string, name string, start_line int, end_line int, context string")
    used = sum(r.tokens for r in packets.repo_map(s, refs, 1500, "filler7").collect())
    assert used <= 0.5 * 2 * count_tokens("class A {\n" + body + "\n}")


def test_outlines(spark):
    rows = [sym("a.swift", "class", "A", 1, 9, "class A", doc="One.\nTwo."), sym("a.swift", "function", "A.f", 2, 3, "func f()"), sym("k.kt", "class", "p.q.A", 1, 9, "class A"), sym("k.kt", "class", "p.q.A.B", 2, 8, "class B", enclosing="A"), sym("k.kt", "method", "p.q.A.B.f", 3, 3, "fun f()", enclosing="A.B"), sym("x.js", "function", "g", 4, 4, "function g() {")]
    got = {r.path: r.outline for r in packets.outlines(spark.createDataFrame(rows, SYMBOL)).collect()}
    assert got["a.swift"] == "/// One.\n/// Two.\nclass A [L1-L9]\n  func f() [L2-L3]"
    assert got["k.kt"] == "class A [L1-L9]\n  class B [L2-L8]\n    fun f() [L3-L3]" and got["x.js"] == "function g() { [L4-L4]"


def test_carts(spark):
    packs = spark.createDataFrame([("p", None, None, [("a.js", "file", None), ("A::a.js", "symbol", "x"), ("a.js", "file", "again"), ("b.js", "file", "Included: b")]), ("q", None, None, [])], "name string, description string, created_at timestamp_ntz, items array<struct<path string, kind string, reason string>>")
    items = packets.pack_items(packs)
    assert {(r.path, r.pos, r.reason) for r in items.collect()} == {("a.js", 0, None), ("A::a.js", 1, "x"), ("b.js", 3, "Included: b")}
    s = spark.createDataFrame([sym("a.js", "class", "A", 1, 2), sym("b.js", "function", "f", 1, 1, "f()")], SYMBOL)
    assert [(r.qualified_name, r.start_line) for r in packets.cart_symbols(items, s).collect()] == [("A", 1)]
    files = spark.createDataFrame([("a.js", "let a"), ("b.js", "long")], "path string, content string")
    got = {r.path: (r.mode, r.section) for r in packets.cart_sections(items, files, packets.outlines(s)).collect()}
    assert got["a.js"] == ("FULL", "## a.js (FULL, Directly Added)\n```javascript\nlet a\n```\n") and got["b.js"][0] == "SKELETON" and "f() [L1-L1]" in got["b.js"][1] and "A::a.js" in got


# ------------------------------------------------------------------------------------------------------------------ links
def test_links(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha beta delta"), (3, "other words"), (4, None), (5, "alpha beta gamma")], "id bigint, text string")
    got = {r.source: (r.links, r.target, r.strength) for r in links.link_counts(items, items, "id", "text").collect()}
    assert got[1] == (2, 5, 1.0) and got[5] == (2, 1, 1.0) and got[2][0] == 2 and got[4] == (0, None, None)
    assert links.link_counts(items, items.limit(0), "id", "text").collect() == []


def test_links_in_blocks_are_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} common") for i in range(40)], "id bigint, text string")
    whole = sorted(map(tuple, links.link_counts(items, items, "id", "text").collect()))
    monkeypatch.setattr(links, "BLOCK", 7)
    monkeypatch.setattr(links, "CHUNK", 9)
    assert sorted(map(tuple, links.link_counts(items.repartition(5), items, "id", "text").collect())) == whole


def test_nearest_vectors_against_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(links, "BLOCK", 3)
    monkeypatch.setattr(links, "CHUNK", 20)
    v = np.random.default_rng(0).normal(size=(50, 8))
    rows = [(i, [float(x) for x in v[i]]) for i in range(50)] + [(50, None), (51, []), (52, [1.0])]
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {(r["query"], r["rank"]): r["item"] for r in links.nearest_vectors(items, items.filter("vec_id % 5 = 0"), k=3).collect()}
    n = v.astype(np.float32).astype(float)
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    for q in range(0, 50, 5):
        s = np.round(n @ n[q], 6)
        s[q] = -2
        assert [got[(q, k)] for k in (1, 2, 3)] == sorted(range(50), key=lambda i: (-s[i], i))[:3]


def test_vectors_meet_those_of_their_length(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 1.0, 0.0]), (5, None)]
    items = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    for parts in (1, 3):
        got = {r["query"]: r["item"] for r in links.nearest_vectors(items.repartition(parts), items.filter("vec_id in (1, 3, 5)"), k=1).collect()}
        assert got == {1: 2, 3: 4}


def test_best_columns():
    import numpy as np

    s = np.random.default_rng(3).integers(0, 4, (40, 30)).astype(float)
    for k in (1, 4, 9):
        assert [list(r) for r in links._best(s, k)] == [sorted(range(30), key=lambda j: (-row[j], j))[:k] for row in s]


def test_places_over_many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = spark.createDataFrame([(f"c{i:03}", "Project" if i % 4 else f"p{i % 3}", "folder" if i % 5 else "file") for i in range(300)], "child string, parent string, grp string").repartition(7)
        got = {}
        for r in links.tree_order(edges).collect():
            got.setdefault(r.parent, []).append((r.place, r.grp != "folder", r.child))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for rows in got.values():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)
    assert links.tree_order(edges.limit(0)).collect() == []


def test_a_range_without_end_costs_nothing(spark):
    s = spark.createDataFrame([sym("a", "class", "A", 1, 2_000_000_000), sym("a", "class", "A.B", 3, 9), sym("a", "function", "A.B.f", 4, 5), sym("a", "function", None or "g", 8, 2)], SYMBOL)
    refs = spark.createDataFrame([("a", "x", 1_999_999_999, 2_000_000_000, None), ("a", "y", 5, 5, None), ("a", "z", 5, 6, None), ("a", "n", None, None, None), (None, "n", 1, 1, None)], "path string, name string, start_line int, end_line int, context string")
    assert {r.name: r.context for r in symbols.enclosing_symbol(refs, s).collect()} == {"x": "A", "y": "A.B.f", "z": "A.B", "n": None}
    assert {r.qualified_name: r.containers for r in symbols.enclosing_types(s).collect()} == {"A": "", "A.B": "A", "A.B.f": "A > A.B", "g": "A > A.B"}


def test_crawl_against_brute_force(spark):
    import random

    rng = random.Random(6)
    staged = [(rng.choice("st"), f"f{rng.randint(0, 9)}") for _ in range(9)]
    refs = [(f"f{rng.randint(0, 9)}", f"N{rng.randint(0, 7)}", 1, 1, None) for _ in range(60)]
    defs = [sym(f"f{rng.randint(0, 12)}", "class", f"N{rng.randint(0, 9)}", 1, 2) for _ in range(40)]
    want = {}
    for stage, path in staged:
        for p, n, *_ in refs:
            for d in defs:
                if p == path and d[3] == n and d[0] != path:
                    want[stage, d[0]] = min(n, want.get((stage, d[0]), "Z"))
    got = symbols.dependency_crawl(spark.createDataFrame(staged, "stage string, path string"), spark.createDataFrame(refs, "path string, name string, start_line int, end_line int, context string"), spark.createDataFrame(defs, SYMBOL))
    assert {(r.stage, r.path): r.reason for r in got.collect()} == {k: f"Defines {v}" for k, v in want.items()}


def test_graphs(spark):
    paths = spark.createDataFrame([("a/b/c.js",), ("a/d.js",), (None,)], "path string")
    edges = links.folder_edges(paths)
    assert {(r.child, r.parent, r.grp) for r in edges.collect()} == {("a", "Project", "folder"), ("a/b", "a", "folder"), ("a/b/c.js", "a/b", "file"), ("a/d.js", "a", "file")}
    assert [r.child for r in links.tree_order(edges).filter("parent = 'a'").orderBy("place").collect()] == ["a/b", "a/d.js"]
    l = spark.createDataFrame([("x", "y", 0.5), ("y", "x", 0.9), ("x", "x", 1.0), ("x", "z", None)], "source string, target string, strength double")
    assert {(r.source, r.target): r.strength for r in links.undirected_links(l).collect()} == {("x", "y"): 0.9, ("x", "z"): 0.0}
    topics = spark.createDataFrame([("a", "auth")], "path string, topic string")
    assert {r.topic for r in links.merged_graph(edges, links.undirected_links(l), topics).filter("source = 'a'").collect()} == {"auth"}


# ------------------------------------------------------------------------------------------------------------------ stats
def test_stats_of_nulls_and_prefixes(spark):
    files = spark.createDataFrame([("a/x", 3, None, 1), ("b/y", None, 2, None)], "path string, size_bytes bigint, doc_lines int, code_lines int")
    s = spark.createDataFrame([sym("a/x", "class", "A", 1, 1)], SYMBOL)
    assert stats.repo_stats(files, s).first().asDict() == {"files": 2, "size_bytes": 3, "doc_lines": 2, "code_lines": 1, "symbols": 1}
    assert stats.repo_stats(files, s, "b/").first().asDict() == {"files": 1, "size_bytes": 0, "doc_lines": 2, "code_lines": 0, "symbols": 0}
    assert stats.repo_stats(files.limit(0), s.limit(0)).first().files == 0
    h = spark.createDataFrame([(1, 10, 40), (2, 90, 45), (3, 5, 0)], "cycle int, naive_tokens bigint, map_tokens bigint")
    assert [r.compression_ratio for r in stats.compression_history(h).orderBy("cycle").collect()] == [0.25, 2.0, 0.0]
    assert tuple(stats.best_compression(h).first()) == (2.0, 3, 0)


def test_skew_join_is_a_join(spark, monkeypatch):
    from lodestone.operators import skew

    left = spark.createDataFrame([("hot", i) for i in range(50)] + [(None, i) for i in range(9)] + [("a", 1), ("b", 2), ("hot", 3)], "k string, v int")
    right = spark.createDataFrame([("hot", "h"), ("a", "x"), ("c", "y"), (None, "n")], "k string, w string")
    plain = {how: sorted(map(str, left.join(right, ["k"], how).select("k", "v", "w").collect())) for how in ("left", "inner")}
    for rows in (5, 1_000_000):
        monkeypatch.setattr(skew, "ROWS", rows)
        for how in plain:
            assert sorted(map(str, skew.skew_join(left, right, ["k"], how).select("k", "v", "w").collect())) == plain[how]


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", None)], "path string, sha256 string")
    new = spark.createDataFrame([("b", "2"), ("c", None), ("d", "1")], "path string, sha256 string")
    changes = index.diff(old, new)
    assert {r.path: r.status for r in changes.collect()} == {"a": "removed", "b": "changed", "c": "unchanged", "d": "added"}
    assert tuple(index.run_counters(changes).first()) == (2, 1, 1) and tuple(index.run_counters(changes.limit(0)).first()) == (0, 0, 0)
    assert {r.path for r in index.stale(old, new).collect()} == {"a"}
