"""Problem 4: functions paired with their documentation.

A lexer per language family turns a file into tokens that keep their offsets: documentation comments, other comments, annotations,
blank lines, function heads, strings that stand alone and other lines. A parsing-expression grammar over them, parsed packrat, emits each
documentation with the lines that it documents; the declaration itself is parsed by the grammar of its language (``grammars``), which gives
the function's name and signature. A pair is dropped if the documentation, without comment marks, rulers, tags,
placeholders, code and whatever name and signature already say, has no word left, or if what is left is said of many functions of all kinds
(``BOILERPLATE``), whatever the language.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.grammars import PYTHON, function_at
from lodestone.llm.items import KEY
from lodestone.llm.packrat import Token, action, choice, many, sequence, token
from lodestone.operators.current import current_files
from lodestone.schema import KINDS
from lodestone.session import ensure_checkpoint_dir

#: Kinds of symbols that are functions, besides unknown ones.
FUNCTIONS = ("function", "method", "initializer", "constructor")
#: Share of the documented functions of a corpus, and number of different names among them, from which on what they all say is boilerplate.
BOILERPLATE, BOILERPLATE_NAMES = 0.05, 30

# ---------------------------------------------------------------------------------------------------------------- lexers
_BRACE = re.compile(
    r"""(?P<doc>/\*\*(?!/)(?:[^*]|\*(?!/))*\*/)
      | (?P<block>/\*(?:[^*]|\*(?!/))*\*/)
      | (?P<long>\"\"\"(?:[^\\"]|\\.|"(?!""))*\"\"\")
      | (?P<string>"(?:[^"\\\n]|\\.)*"|`(?:[^`\\]|\\.)*`|'(?:[^'\\\n]|\\.)*')
      | (?P<slash>//[^\n]*)""",
    re.X | re.S,
)
_BRACE_START = re.compile(r'/[/*]|"|`|\'')
#: In other languages than these a backtick opens no string.
BACKTICKS = frozenset(("swift", "kt", "kts", "java", "js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts", "go", "scala"))
_PLAIN_START = re.compile(r'/[/*]|"|\'')
_ANNOTATION = re.compile(r"@[\w.]+(?:\((?:[^()\n]|\([^()\n]*\))*\))?\s*$")


def _by_line(text: str, spans: list[tuple[str, int, int]]) -> list[Token]:
    """Tokens of a file from its multi-line constructs: each line that lies in none becomes a token of its own."""
    out: list[Token] = []
    at, line, k = 0, 1, 0
    n = len(text)
    while at < n:
        while k < len(spans) and spans[k][2] <= at:
            k += 1
        stop = text.find("\n", at)
        stop = n if stop < 0 else stop
        body = text[at:stop].strip()
        if k < len(spans) and spans[k][1] <= stop and spans[k][1] >= at and not text[at : spans[k][1]].strip():
            kind, start, end = spans[k]
            rest = text.find("\n", end)
            rest = n if rest < 0 else rest
            last = line + text.count("\n", start, end)
            if text[end:rest].strip():  # code follows on the line where the comment ends
                out.append(Token(kind, start, end, line, last))
                out.append(Token("code", end, rest, last, last))
            else:
                out.append(Token(kind, start, end, line, last))
            at, line = rest + 1, last + 1
            continue
        kind = "blank" if not body else "annotation" if body[0] == "@" and _ANNOTATION.match(body) else "code"
        last = line
        # A construct that starts behind code and spans lines belongs to this token.
        while k < len(spans) and spans[k][1] <= stop:
            if spans[k][2] > stop:
                stop = text.find("\n", spans[k][2])
                stop = n if stop < 0 else stop
            k += 1
        last = line + text.count("\n", at, stop)
        out.append(Token(kind, at, stop, line, last))
        at, line = stop + 1, last + 1
    return out


def lex_brace(text: str, backticks: bool = True) -> list[Token]:
    """Languages whose documentation stands in ``///`` or ``/** */`` comments."""
    spans: list[tuple[str, int, int]] = []
    at = 0
    opens = _BRACE_START if backticks else _PLAIN_START
    while (m := opens.search(text, at)) is not None:
        w = _BRACE.match(text, m.start())
        if w is None:
            at = m.start() + 1
            continue
        at = w.end()
        if w["doc"] is not None or (w["slash"] or "").startswith("///") and not (w["slash"] or "").startswith("////"):
            spans.append(("doc" if w["doc"] is not None else "docline", w.start(), w.end()))
        elif w["block"] is not None or w["slash"] is not None:
            spans.append(("comment", w.start(), w.end()))
        elif "\n" in w[0]:
            spans.append(("string", w.start(), w.end()))
    return _by_line(text, spans)


_PY = re.compile(r'''(?P<long>[rRbBuUfF]{0,2}("""|\'\'\')(?:[^\\]|\\.)*?\2)|(?P<string>[rRbBuUfF]{0,2}(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'))|(?P<hash>\#[^\n]*)''', re.S)
_PY_START = re.compile(r"[\"'#]")
_DEF = re.compile(r"[ \t]*(?:async[ \t]+)?def\b")


def lex_python(text: str) -> list[Token]:
    spans: list[tuple[str, int, int]] = []
    at = 0
    while (m := _PY_START.search(text, at)) is not None:
        w = _PY.match(text, m.start())
        if w is None:
            at = m.start() + 1
            continue
        at = w.end()
        start = w.start()
        alone = not text[text.rfind("\n", 0, start) + 1 : start].strip(" \trRuUbB")
        if w["hash"] is not None:
            spans.append(("comment", start, w.end()))
        elif alone:
            spans.append(("literal", start, w.end()))
        elif "\n" in w[0]:
            spans.append(("string", start, w.end()))
    out: list[Token] = []
    open_head = 0
    for t in _by_line(text, spans):
        if t.kind in ("code", "annotation") or (open_head and t.kind != "comment"):
            body = text[t.start : t.end]
            if open_head or _DEF.match(body):
                code = re.sub(r"#[^\n]*|\"[^\"\n]*\"|'[^'\n]*'", "", body)
                open_head = open_head + sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}") if open_head else sum(code.count(c) for c in "([{") - sum(code.count(c) for c in ")]}")
                done = open_head <= 0
                open_head = max(0, open_head)
                if out and out[-1].kind == "opening":
                    t = Token("head" if done else "opening", out.pop().start, t.end, 0, t.last)._replace(line=opened)
                else:
                    opened = t.line
                    t = t._replace(kind="head" if done else "opening")
        out.append(t)
    return out


# -------------------------------------------------------------------------------------------------------------- grammars
#   Unit        <- (Documented / Token)*
#   Documented  <- Doc (Blank / Annotation)* Code          Doc <- DocLine+ / DocBlock          Code: a declaration, see ``grammars``
#   Python: Documented <- Head (Blank / Comment)* Literal
_Any = token("doc", "docline", "comment", "string", "annotation", "blank", "code", "literal", "head", "opening")
_Between = many(token("blank", "annotation"))
_Doc = choice(action(many(token("docline"), 1), lambda ts: (ts[0], ts[-1])), action(token("doc"), lambda t: (t, t)))
_Documented = action(sequence(_Doc, _Between, token("code")), lambda v: (v[0][0].start, v[0][1].end, min(v[0][1].last + 1, v[2].line), v[2].line, next((t.start for t in v[1] if t.kind == "annotation"), v[2].start)))
_Unit = many(choice(_Documented, action(_Any, lambda t: None)))
_PyDocumented = action(sequence(token("head"), many(token("blank", "comment")), token("literal")), lambda v: (v[2].start, v[2].end, v[0].line, v[0].line, v[0].start))
_PyUnit = many(choice(_PyDocumented, action(_Any, lambda t: None)))


class Documented(NamedTuple):
    first: int  # lines from below the documentation to the declaration, annotations included
    last: int
    documentation: str
    name: str | None  # of the function declared there; null for other declarations
    signature: str | None


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def documented(path: str, text: str, parse: bool = True) -> list[Documented]:
    """Each documented declaration of a file, in any language whose documentation looks like one of the three forms. With ``parse``,
    names and signatures of functions."""
    if not text:
        return []
    ext = extension_of(path)
    if ext in PYTHON:
        found = _PyUnit(lex_python(text), 0, {})
    elif "/**" in text or "///" in text:
        found = _Unit(lex_brace(text, ext in BACKTICKS), 0, {})
    else:
        return []
    out = []
    for v in (x for x in (found[0] if found else []) if x is not None):
        f = function_at(text, v[4], ext) if parse else None
        out.append(Documented(v[2], v[3], text[v[0] : v[1]], f.name if f else None, text[f.start : f.end] if f else None))
    return out


def documented_lines(path: str, text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, documentation) of each documented declaration."""
    return [tuple(d[:3]) for d in documented(path, text, False)]


# -------------------------------------------------------------------------------------------------------- informativeness
# Words that say nothing about a function by themselves.
EMPTY_WORDS = frozenset(
    """a an and are as at be by do does for from has have in is it its of on or that the this these those to was were will with
    function functions method methods func fun def procedure routine member subroutine constructor initializer init initializes initialize initialise instance new
    return returns returned returning result results value values output param params parameter parameters arg args argument arguments
    description describe summary doc docs documentation comment comments javadoc kdoc docstring header
    todo fixme xxx hack tbd tba tbc wip none na n/a missing write add fill enter put insert here later soon please placeholder stub dummy template undocumented generated auto automatically autogenerated
    see parent base super superclass overridden override overrides inherit inherited inheritdoc same above below mark pragma region endregion
    created date author since version copyright file type types void nil null self some something stuff thing things etc used use uses implementation implements impl
    throws raises throw default goes no given specified provided corresponding current object objects variable variables class property name helper convenience utility document write documents document internal
    beschreibung funktion methode fehlt siehe fonction méthode voir función método descripción falta ver função descrição 説明 関数 メソッド なし 未記入""".split()
)
_MARKS = re.compile(r"^\s*(?:/\*\*+|/\*!?|///+!?|//!?|\*+/|\*(?!\*)|#+)?[ \t]?|\s*\*+/\s*$")
_PLACEHOLDER = re.compile(r"<#.*?#>|\{@inheritDoc\}|\[(?:description|summary|todo|doc|docs|documentation|text|insert|enter|brief|title|name)[^\]]*\]|<(?:description|summary|todo|p|/p|br)[^>]*>", re.I)
_TAG = re.compile(r"^\s*(?:[-*]\s+)?(?:[@\\:](?P<tag>\w+):?|(?P<plain>Parameters?|Returns?|Throws|Args?|Arguments|Raises|Precondition|Postcondition|Note|Remark|Complexity)\s*(?P<pname>[\w.]*)\s*:)\s*(?P<rest>.*)$", re.I)
_ITEM = re.compile(r"^\s*[-*•]?\s*`?(?P<name>[A-Za-z_]\w*)`?\s*(?:\([\w., ]*\))?\s*:\s+(?P<rest>.*)$")
_EMPTY_TAGS = {"author", "since", "version", "date", "see", "link", "copyright", "file", "inheritdoc", "override", "generated", "hide", "suppress", "ignore", "private", "public", "internal", "protected", "static", "async", "function", "method", "constructor", "class", "memberof", "name", "type", "module", "kind"}
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_SPLIT = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|[^\W\d_A-Za-zÀ-ÿ]+")
_CODE_LINE = re.compile(
    r"^\s*(?:(?:let|var|val|const|final|auto)\s+\w+\s*(?::[^=]+)?=\s*\S.*|return\s+[\w.]+(?:\(.*\))?;?|(?:await\s+|try\s+)?[\w.]+\(.*\);?|[\w.\[\]\"']+\s*[-+*/]?=\s*\S.*"
    r"|(?:if|for|while|guard|switch)\s*\(?.*[{:]|import\s+[\w.]+;?|[{}();\[\]]+|>>>.*|\$ .*)$"
)
_DATE_LINE = re.compile(r"^\s*(?:created|last (?:modified|changed|updated)|modified|updated|written|generated|copyright)\b[^A-Za-z]*(?:(?:by|on|at|in)\b)?.*\d", re.I)
_SECTION = re.compile(r"^\s*(?:MARK|TODO|FIXME|XXX|HACK|NOTE|SECTION|region|pragma mark)\s*:?\s*-\s*.*$|^\s*(?:#?(?:end)?region|#?pragma mark|MARK:)\b.*$")
_AUTO = re.compile(r"^\s*(?:todo:?\s*)?(?:auto-?generated|automatically generated|generated)\b.{0,60}$", re.I)


def _stem(word: str) -> str:
    w = word.lower()
    for suffix, put in (("ies", "y"), ("ied", "y"), ("ying", "y"), ("sses", "ss"), ("ing", ""), ("ed", ""), ("es", ""), ("s", "")):
        if w.endswith(suffix) and len(w) - len(suffix) >= 2 and not (suffix == "s" and w.endswith("ss")):
            w = w[: -len(suffix)] + put
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "ls":
        w = w[:-1]
    return w[:-1] if len(w) > 3 and w.endswith("e") else w


def _stems(text: str) -> set[str]:
    return {_stem(p) for w in _WORD.findall(text.replace("_", " ")) for p in (*_SPLIT.findall(w), w)}


_EMPTY = {_stem(w) for w in EMPTY_WORDS} | {w for w in EMPTY_WORDS}


def documentation_text(doc: str) -> str:
    """Without comment marks and quotes, line by line."""
    t = doc.replace("\r\n", "\n").strip()
    t = re.sub(r"^[rRuUbB]{0,2}(\"\"\"|'''|\"|')(.*)\1$", r"\2", t, flags=re.S)
    return "\n".join(_MARKS.sub("", x).rstrip() for x in t.split("\n")).strip()


def said_besides(doc: str, name: str, signature: str) -> list[str]:
    """The words in which the documentation says something that name and signature do not; none if it says nothing."""
    out: list[str] = []
    said = _stems(name or "") | _stems(signature or "")
    text = _PLACEHOLDER.sub(" ", documentation_text(doc))
    for line in text.split("\n"):
        if not line.strip() or _SECTION.match(line) or _DATE_LINE.match(line) or _AUTO.match(line):
            continue
        tag = _TAG.match(line)
        if tag:
            kind = (tag["tag"] or tag["plain"]).lower()
            rest = tag["rest"]
            if kind in _EMPTY_TAGS:
                continue
            if kind.startswith(("param", "arg", "property", "throws", "exception", "raises")) and not tag["pname"]:
                rest = re.sub(r"^\s*(?:\{[^}]*\}\s*)?[`*]*[\w.]+[`*]*\s*[-:–]?\s*", "", rest, count=1)
            line = rest
        elif (item := _ITEM.match(line)) and _stem(item["name"]) in said:
            line = item["rest"]
        if _CODE_LINE.match(line):
            continue
        for word in _WORD.findall(line.replace("_", " ")):
            parts = _SPLIT.findall(word) or [word]
            if any(_stem(p) not in said and p.lower() not in _EMPTY and _stem(p) not in _EMPTY and (len(p) > 1 or ord(p) > 0x2E80) for p in parts):
                out.append(word.lower())
    return out


def informative(doc: str, name: str, signature: str) -> bool:
    """Whether the documentation says in words something that name and signature do not."""
    return bool(said_besides(doc, name, signature))


def said_hash(doc: str | None, name: str | None, qualified: str | None, signature: str | None) -> int | None:
    """A hash of ``said_besides``, null where nothing is said."""
    words = said_besides(doc or "", f"{name or ''} {(qualified or '').rsplit('.', 1)[-1]}", signature or "")
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if words else None


# ------------------------------------------------------------------------------------------------------------- operators
_LINES = "path string, line int, found string"
_FUNCTIONS = "path string, name string, signature string, start_line int, raw string"


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(p, n, d.documentation) for p, t in zip(b["path"], b["content"]) for d in documented(p, t or "", False) for n in range(d.first, d.last + 1)]
        yield pd.DataFrame(rows, columns=["path", "line", "found"])


def _extract_functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(p, d.name, d.signature, d.last, d.documentation) for p, t in zip(b["path"], b["content"]) for d in documented(p, t or "") if d.name is not None]
        yield pd.DataFrame(rows, columns=["path", "name", "signature", "start_line", "raw"])


def file_documentation(files: DataFrame) -> DataFrame:
    """(path, line, found): documentation in current contents, for each line of the declaration it belongs to."""
    return current_files(files, ["path", "content"]).mapInPandas(_extract, _LINES)


@F.pandas_udf(T.LongType())
def _said(doc: pd.Series, name: pd.Series, qualified: pd.Series, signature: pd.Series) -> pd.Series:
    return pd.Series([said_hash(*x) for x in zip(doc, name, qualified, signature)], dtype="Int64")


@F.pandas_udf(T.StringType())
def _clean(doc: pd.Series) -> pd.Series:
    return doc.map(documentation_text)


def informative_only(rows: DataFrame) -> DataFrame:
    """Rows with ``raw`` documentation, ``name, qualified_name, signature`` that say something, ``documentation`` without marks in place of ``raw``.

    What at least ``BOILERPLATE`` of all rows that say something say, of ``BOILERPLATE_NAMES`` different names, is dropped: there are at most
    1 / ``BOILERPLATE`` such texts, which are broadcast.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    said = rows.withColumn("said", _said("raw", "name", "qualified_name", "signature")).filter("said is not null").checkpoint()  # read twice, parsed once
    total = said.agg(F.count("*").alias("total"))  # one row
    counts = said.groupBy("said").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).filter((F.col("n") >= BOILERPLATE * F.col("total")) & (F.col("n") >= BOILERPLATE_NAMES))
    frequent = said.join(F.broadcast(counts.select("said")), "said", "left_semi").groupBy("said").agg(F.count_distinct("name").alias("names")).filter(F.col("names") >= BOILERPLATE_NAMES)
    kept = said.join(F.broadcast(frequent.select("said")), "said", "left_anti")
    return kept.withColumn("documentation", _clean("raw")).drop("raw", "said")


def extracted_functions(files: DataFrame) -> DataFrame:
    """Pairs straight from the current files, whatever symbols are recorded: ``path, name, signature, start_line, documentation`` of every
    function that a grammar recognises below informative documentation. Extensions without a grammar of their own are tried by all."""
    found = current_files(files, ["path", "content"]).mapInPandas(_extract_functions, _FUNCTIONS).withColumn("qualified_name", F.col("name"))
    return informative_only(found).select("path", "name", "signature", "start_line", "documentation")


def documented_functions(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Function-like symbols with informative documentation: their key, ``name, signature, documentation``.

    Kinds that are null or unknown count as functions. A documentation in ``doc_comment`` goes first; where it is null or blank, the one
    in the file. Of rows that repeat a key, the greatest comment, signature and name are taken.
    """
    function_like = F.col("kind").isNull() | F.col("kind").isin(*FUNCTIONS) | ~F.col("kind").isin(*KINDS)
    blank = F.regexp_replace(F.coalesce("doc_comment", F.lit("")), r"\s", "") == ""
    keys = symbols.filter(function_like & F.col("path").isNotNull()).groupBy(*KEY).agg(F.max(F.when(~blank, F.col("doc_comment"))).alias("own"), F.max("signature").alias("signature"), F.max("name").alias("name"))
    found = file_documentation(files).groupBy("path", F.col("line").alias("start_line")).agg(F.max("found").alias("found"))
    joined = keys.join(found, ["path", "start_line"], "left").withColumn("raw", F.coalesce("own", "found")).filter("raw is not null")
    return informative_only(joined.select(*KEY, "name", "signature", "raw")).select(*KEY, "name", "signature", "documentation")
