"""Symbols and references from source text.

JavaScript, TypeScript, Python, Java and CSS are matched line by line with patterns, in Catalyst and inside the row. Swift and Kotlin go
through a scanner in Arrow batches: comments and strings are blanked out with their offsets kept, then declarations are read off with
a stack of blocks. Every file that gives no symbol becomes one symbol of kind ``file``.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import extension, split_lines, trim_line
from lodestone.functions.tokens import count_tokens, token_estimate
from lodestone.session import ensure_checkpoint_dir

# What a line must hold to declare a symbol, by language family; the name is the last group that takes part.
_JS = {
    "class": r"\bclass\s+([a-zA-Z0-9_]+)",
    "interface": r"\binterface\s+([a-zA-Z0-9_]+)",
    "function": r"\b(?:function|async\s+function)\s+([a-zA-Z0-9_]+)|(?:const|let|var)\s+([a-zA-Z0-9_]+)\s*=\s*(?:async\s*)?\(.*?\)\s*=>",
    "property": r"\b(?:const|let|var)\s+([a-zA-Z0-9_]+)\s*=",
}
_CSS = {"style": r"^\s*([.#]?[a-zA-Z0-9_-]+)\s*\{"}
_PYTHON = {"class": r"^class\s+([a-zA-Z0-9_]+)", "function": r"^def\s+([a-zA-Z0-9_]+)"}
_JAVA = {
    "class": r"\bclass\s+([a-zA-Z0-9_]+)",
    "interface": r"\binterface\s+([a-zA-Z0-9_]+)",
    "method": r"\b(?:public|protected|private|static|\s) +[\w\<\>\[\]]+\s+([a-zA-Z0-9_]+)\s*\(",
}
# What is read from Kotlin lines where the scanner is not wanted.
_KOTLIN_LINES = {"class": r"\bclass\s+([a-zA-Z0-9_]+)", "interface": r"\binterface\s+([a-zA-Z0-9_]+)", "function": r"\bfun\s+([a-zA-Z0-9_]+)"}
PATTERNS = {("js", "ts", "jsx", "tsx"): _JS, ("css", "scss", "less"): _CSS, ("py",): _PYTHON, ("java",): _JAVA}
#: Where several kinds match one line with one name, the first of these is taken.
KIND_ORDER = ("class", "interface", "function", "method", "property", "style")


def _matches(line: Column, patterns: dict[str, str]) -> Column:
    """Array of (kind, name) of a line; a name once."""
    found = []
    for kind in [k for k in KIND_ORDER if k in patterns]:
        p = patterns[kind]
        name = F.regexp_extract(line, p, 1)
        if p.count("(") - p.count("(?:") - p.count(r"\(") > 1:
            name = F.coalesce(F.nullif(F.regexp_extract(line, p, 2), F.lit("")), name)
        found.append(F.when(line.rlike(p), F.struct(F.lit(kind).alias("kind"), name.alias("name"))))
    all_ = F.array_compact(F.array(*found))
    names = F.transform(all_, lambda x: x["name"])
    return F.filter(F.transform(all_, lambda x, i: F.when(F.array_position(names, x["name"]) == i + 1, x)), lambda x: x.isNotNull())


def _numbered(patterns: dict[str, str]) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(_matches(x, patterns).alias("found"), x.alias("text"), (i + 1).alias("line"))


def kotlin_line_symbols(files: DataFrame) -> DataFrame:
    """X11: classes, interfaces and functions of Kotlin files by line, in place of the scanner."""
    return regex_symbols(files, {("kt", "kts"): _KOTLIN_LINES})


def regex_symbols(files: DataFrame, families: dict[tuple[str, ...], dict[str, str]] = PATTERNS) -> DataFrame:
    """``path, kind, name, signature, line, tokens`` from the lines of files whose extension has patterns."""
    e = extension("path")
    lines = split_lines("content")
    per_line = None
    for exts, patterns in families.items():
        each = F.transform(lines, _numbered(patterns))
        per_line = F.when(e.isin(*exts), each) if per_line is None else per_line.when(e.isin(*exts), each)
    held = F.filter(per_line, lambda x: F.size(x["found"]) > 0)
    known = [x for exts in families for x in exts]
    rows = files.filter(e.isin(*known) & F.col("content").isNotNull()).select("path", F.explode(held).alias("l")).select("path", "l.line", "l.text", F.explode("l.found").alias("s"))
    return rows.select("path", "s.kind", "s.name", trim_line("text").alias("signature"), "line", token_estimate("text").alias("tokens"))


# ----------------------------------------------------------------------------------------------------------------- scanner
_MASK = re.compile(r'/\*|//[^\n]*|#?"""|#*"|\'(?:\\.|[^\'\\\n])\'')


def masked(text: str) -> str:
    """The text with comments and string contents as blanks of the same length; line ends stay. Nested block comments are followed."""
    out, at, n = [], 0, len(text)
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    while (m := _MASK.search(text, at)) is not None:
        out.append(text[at : m.start()])
        start, opener = m.start(), m[0]
        if opener == "/*":
            depth, end = 1, m.end()
            while depth and (c := re.compile(r"/\*|\*/").search(text, end)) is not None:
                depth += 1 if c[0] == "/*" else -1
                end = c.end()
            end = n if depth else end
        elif opener.endswith('"""'):
            close = text.find('"""', m.end())
            end = n if close < 0 else close + 3
        elif opener.endswith('"'):
            hashes = len(opener) - 1
            close = re.compile(r'"' + "#" * hashes if hashes else r'(?:\\.|[^"\\\n])*("|\n|$)').search(text, m.end())
            end = n if close is None else close.end() - (1 if not hashes and close[1] == "\n" else 0)
        else:
            end = m.end()
        out.append(blank(text[start:end]))
        at = end
    out.append(text[at:])
    return "".join(out)


def _pairs(code: str) -> dict[int, int]:
    """Offset of the closing brace of each opening one; the end of the text for those that stay open."""
    stack, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            out[stack.pop()] = m.start()
    return out | {s: len(code) for s in stack}


_HEAD_SIGN = re.compile(r"[(\[)\]{};=\n]")
_HEAD_GOES_ON = re.compile(r"\s*(?:where|throws|async|rethrows|->|:|,)")


def _head_end(code: str, at: int) -> int:
    """Where a declaration's head ends: at a brace, ``=`` or line end outside parentheses, brackets and angles."""
    depth = 0
    for m in _HEAD_SIGN.finditer(code, at):
        c, i = m[0], m.start()
        if c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif depth <= 0 and (c in "{};" or (c == "=" and code[i + 1 : i + 2] not in ("=", ">")) or (c == "\n" and not _HEAD_GOES_ON.match(code, i) and not code[at:i].rstrip().endswith((",", ":", "->")))):
            return i
    return len(code)


def _squeeze(s: str) -> str:
    return re.sub(r"\s+", " ", s).strip()


def _doc_above(lines: list[str], line: int) -> str | None:
    """Text of the ``///`` lines or the block comment above a line (from 0), annotations skipped."""
    i = line - 1
    while i >= 0 and (not lines[i].strip() or lines[i].strip().startswith("@")):
        i -= 1
    if i < 0:
        return None
    last = lines[i].strip()
    if last.startswith("///"):
        first = i
        while first > 0 and lines[first - 1].strip().startswith("///"):
            first -= 1
        return "\n".join(x.strip()[3:].strip() for x in lines[first : i + 1])
    if last.endswith("*/"):
        first = i
        while first > 0 and "/*" not in lines[first]:
            first -= 1
        if "/**" not in lines[first]:
            return None
        body = [re.sub(r"^\s*(?:/\*\*|\*(?!/))?\s?|\s*\*/\s*$", "", x).strip() for x in lines[first : i + 1]]
        return "\n".join(x for x in body if x)
    return None


# Words that open declarations, modifiers and access levels of the two languages.
_SWIFT_TYPES = {"struct", "class", "actor", "enum", "protocol", "extension"}
_SWIFT_DECL = re.compile(r"\b(?P<word>struct|class|actor|enum|protocol|extension|func|init|var|let|case)\b(?!\s*[:,.)])|(?P<open>\{)|(?P<close>\})")
_SWIFT_ACCESS = ("open", "public", "internal", "fileprivate", "private")
_KEYWORDS = frozenset(
    """actor any as associatedtype async await break case catch class continue convenience default defer deinit didSet do dynamic else enum extension
    fallthrough false fileprivate final for func get guard if import in indirect infix init inout internal is lazy let mutating nil nonisolated open operator
    override postfix precedencegroup prefix private protocol public repeat required rethrows return self Self set some static struct subscript super switch
    throw throws true try typealias unowned var weak where while willSet abstract annotation by companion const constructor crossinline data expect actual
    external field fun inline inner interface lateinit noinline null object out package property reified sealed suspend tailrec this typeof val value vararg when""".split()
)
_TEST_PATH = re.compile(r"Tests/")


def _symbol(kind: str, name: str, scope: list[str], signature: str, access: str | None, first: int, last: int, doc: str | None, text: str) -> dict:
    return {
        "kind": kind, "name": name, "qualified_name": ".".join([*scope, name]), "signature": signature, "enclosing_type": scope[-1] if scope else None,
        "access_level": access, "start_line": first, "end_line": last, "doc_comment": doc, "estimated_tokens": count_tokens(text),
    }


def _line_table(text: str) -> list[int]:
    return [0, *[m.end() for m in re.finditer("\n", text)]]


_ATTRIBUTES = re.compile(r"\s*(?:@[\w.:]+(?:\([^\n]*\))?\s*)+$")


def _declaration_start(code: str, at: int) -> int:
    """Offset of the declaration's first modifier or annotation: on its own line, or on lines above that hold annotations only."""
    start = code.rfind("\n", 0, at) + 1
    brace = max(code.rfind(c, start, at) for c in "{};")
    if brace >= 0:
        start = brace + 1
    else:
        while start > 0 and _ATTRIBUTES.match(code[(up := code.rfind("\n", 0, start - 1) + 1) : start - 1]):
            start = up
    return start + len(code[start:at]) - len(code[start:at].lstrip())


def swift_symbols(text: str, path: str) -> list[dict]:
    """Types, extensions, functions, initializers, member properties, enum cases and tests of a Swift file."""
    code = masked(text)
    pairs, starts, lines = _pairs(code), _line_table(text), text.split("\n")
    line_of = lambda i: bisect_right(starts, i)
    out: list[dict] = []
    blocks: list[tuple[int, str]] = []  # (end, kind): kind is a type, "code" or "other"
    scope: list[str] = []
    pending: dict[int, tuple[str, str | None]] = {}
    for m in _SWIFT_DECL.finditer(code):
        if m["open"]:
            kind, name = pending.pop(m.start(), ("other", None))
            blocks.append((pairs[m.start()], kind))
            if name is not None:
                scope.append(name)
            continue
        if m["close"]:
            if blocks and blocks[-1][0] == m.start():
                _, kind = blocks.pop()
                if kind in _SWIFT_TYPES and scope:
                    scope.pop()
            continue
        word, member = m["word"], bool(blocks) and blocks[-1][1] in _SWIFT_TYPES
        begin = _declaration_start(code, m.start())
        before = code[begin : m.start()].split()
        access = next((a for a in _SWIFT_ACCESS if any(x.startswith(a) for x in before)), None)
        if word == "class" and re.match(r"\s+(?:func|var|let|subscript)\b", code[m.end() :]):
            continue  # a modifier
        end = _head_end(code, m.end())
        head = _squeeze(code[m.end() : end])
        doc = _doc_above(lines, line_of(begin) - 1)
        if word in _SWIFT_TYPES:
            found = re.match(r"([\w.]+)\s*(<[^{]*?>)?\s*(:\s*[^{]*?)?\s*(?:where\b.*)?$", head)
            if not found or code[end : end + 1] != "{":
                continue
            name = found[1]
            generic = "" if word in ("protocol", "extension") else (found[2] or "")
            signature = f"{word} {name}{generic}{_squeeze(found[3]) if found[3] else ''}"
            last = pairs[end]
            out.append(_symbol(word, name, scope, signature, None if word == "extension" else access, line_of(begin), line_of(min(last, len(text) - 1)), doc, text[begin : last + 1]))
            pending[end] = (word, name)
        elif word in ("func", "init"):
            found = re.match(r"([\w`]+|[-+*/<>=!&|^~%]+)\s*(<[^(]*>)?\s*(\(.*)$", head) if word == "func" else re.match(r"()([?!]?)\s*(\(.*)$", head)
            if not found or (word == "init" and not member):
                continue
            body = code[end : end + 1] == "{"
            last = pairs[end] if body else end - 1
            name = found[1].strip("`") if word == "func" else "init"
            signature = f"func {name}{found[3]}" if word == "func" else f"init{found[2]}{found[3]}"
            test = word == "func" and name.startswith("test") and ((scope and scope[-1].endswith("Tests")) or _TEST_PATH.search(path))
            kind = "test" if test else "function" if word == "func" else "initializer"
            out.append(_symbol(kind, name, scope, signature, access, line_of(begin), line_of(min(last, len(text) - 1)), doc, text[begin : last + 1]))
            if body:
                pending[end] = ("code", None)
        elif word in ("var", "let"):
            found = re.match(r"(\w+)\s*(:\s*.+)?$", head)
            if not member or not found:
                continue
            last = pairs[end] if code[end : end + 1] == "{" else code.find("\n", end) if code.find("\n", end) >= 0 else len(code)
            kind_text = (found[2] or "").rstrip()
            out.append(_symbol("property", found[1], scope, f"{word} {found[1]}{kind_text}", access, line_of(begin), line_of(min(last - (code[end : end + 1] != "{"), len(text) - 1)), doc, text[begin : last + 1]))
            if code[end : end + 1] == "{":
                pending[end] = ("code", None)
        elif word == "case" and blocks and blocks[-1][1] == "enum":
            stop = code.find("\n", m.end())
            rest = code[m.end() : stop if stop >= 0 else len(code)]
            raw = text[m.end() : stop if stop >= 0 else len(text)]
            for e in re.finditer(r"(\w+)\s*(\([^)]*\))?\s*(=\s*[^,]+)?(?:,|$)", rest):
                if e[1]:
                    body = raw[e.start() : e.end()].rstrip(", ").strip()
                    out.append(_symbol("case", e[1], scope, f"case {body}", None, line_of(m.start()), line_of(m.start()), doc, body))
    return out


_KOTLIN_DECL = re.compile(r"\b(?P<word>class|interface|object|fun|val|var|constructor|typealias|init)\b|(?P<open>\{)|(?P<close>\})")
_KOTLIN_TYPES = {"class", "interface", "enum", "dataClass", "sealedClass", "valueClass", "object", "companion"}
_KOTLIN_TEST = re.compile(r"src/(?:test|androidTest|iosTest)/kotlin/")
_KOTLIN_TEST_MARK = re.compile(r"@(?:Test|ParameterizedTest|RepeatedTest)\b")


def kotlin_symbols(text: str, path: str) -> list[dict]:
    """Types, objects, functions, properties, constructors, enum entries and aliases of a Kotlin file, names under the package.

    Nothing inside a function is indexed; a function with an enclosing type is a method. The access level is read from the head.
    """
    code = masked(text)
    pairs, starts, lines = _pairs(code), _line_table(text), text.split("\n")
    line_of = lambda i: bisect_right(starts, i)
    package = re.search(r"^\s*package\s+([\w.]+)", code, re.M)
    scope: list[str] = []
    prefix = package[1].split(".") if package else []
    out: list[dict] = []
    blocks: list[tuple[int, str]] = []
    pending: dict[int, tuple[str, str | None]] = {}

    def add(kind: str, name: str, signature: str, access: str | None, begin: int, last: int, doc: str | None) -> None:
        s = _symbol(kind, name, [*prefix, *scope], signature, access, line_of(begin), line_of(min(max(last, begin), len(text) - 1)), doc, text[begin : last + 1])
        out.append(s | {"enclosing_type": ".".join(scope) or None})

    for m in _KOTLIN_DECL.finditer(code):
        if m["open"]:
            kind, name = pending.pop(m.start(), ("other", None))
            blocks.append((pairs[m.start()], kind))
            if name is not None:
                scope.append(name)
                if kind == "enum":  # entries stand ahead of the first semicolon or member
                    body = code[m.end() : pairs[m.start()]]
                    stop = re.search(r";|\b(?:fun|val|var|companion|override)\b", body)
                    depth, at = 0, 0
                    for e in re.finditer(r"[({]|[)}]|\b[A-Za-z_]\w*", body[: stop.start() if stop else None]):
                        if e[0] in "({":
                            depth += 1
                        elif e[0] in ")}":
                            depth -= 1
                        elif depth == 0 and not body[at : e.start()].strip(" \n\t\r,"):
                            add("enumEntry", e[0], e[0], None, m.end() + e.start(), m.end() + e.end() - 1, None)
                        at = e.end() if depth == 0 else at
            continue
        if m["close"]:
            if blocks and blocks[-1][0] == m.start():
                _, kind = blocks.pop()
                if kind in _KOTLIN_TYPES and scope:
                    scope.pop()
            continue
        if any(k not in _KOTLIN_TYPES for _, k in blocks):
            continue  # inside a function, an accessor or an initializer
        word = m["word"]
        begin = _declaration_start(code, m.start())
        before = code[begin : m.start()]
        if re.search(r"[.:(,?<]\s*$", before) and word not in ("val", "var"):
            continue
        end = _head_end(code, m.end())
        head = _squeeze(code[m.end() : end])
        marks = before
        access = next((a for a in ("public", "private", "protected", "internal") if re.search(rf"\b{a}\b", before)), None)
        doc = _doc_above(lines, line_of(begin) - 1)
        body = code[end : end + 1] == "{"
        if word in ("class", "interface", "object"):
            if word == "object" and re.search(r"[=(]\s*$", before):
                continue
            companion = "companion" in before.split()
            found = re.match(r"(\w+)", head)
            name = found[1] if found else "Companion" if companion else "object"
            modifiers = before.split()
            kind = (
                "interface" if word == "interface" else "companion" if companion else "object" if word == "object"
                else "enum" if "enum" in modifiers else "dataClass" if "data" in modifiers else "sealedClass" if "sealed" in modifiers else "valueClass" if "value" in modifiers else "class"
            )
            shown = " ".join(x for x in modifiers if not x.startswith("@") and x not in ("public", "private", "protected", "internal"))
            last = pairs[end] if body else end - 1
            add(kind, name, _squeeze(f"{shown} {word} {head}"), access, begin, last, doc)
            if body:
                pending[end] = (kind, name)
            params = re.match(r"\w+\s*(?:<[^(]*>)?\s*(?:\w+\s+)?\((.*)\)", head, re.S)
            if params and word == "class":
                scope.append(name)
                for p in re.finditer(r"\b(val|var)\s+(\w+)\s*(:\s*[^,=]+)?", params[1]):
                    add("property", p[2], _squeeze(f"{p[1]} {p[2]}{p[3] or ''}"), None, begin, end - 1, None)
                scope.pop()
        elif word == "fun":
            found = re.match(r"(?:<[^>]*>\s*)?(?:[\w<>?,. ]+\.)?(`[^`]+`|\w+)\s*\(", head) or re.match(r"(?:<[^>]*>\s*)?(?:[\w<>?,. ]+\.)?(`[^`]+`|\w+)\s*\(", _squeeze(text[m.end() : end]))
            if not found:
                continue
            raw = _squeeze(text[m.end() : end])
            name = found[1].strip("`")
            if code[end : end + 1] == "=":
                stop = code.find("\n", end)
                last = stop - 1 if stop >= 0 else len(code) - 1
            else:
                last = pairs[end] if body else end - 1
            test = _KOTLIN_TEST_MARK.search(marks) or (scope and re.search(r"Tests?$", scope[-1]) and name.startswith("test")) or (_KOTLIN_TEST.search(path) and (name.startswith("test") or found[1][0] == "`"))
            add("test" if test else "method" if scope else "function", name, re.sub(r"^(?:<[^>]*>\s*)", "", f"{raw}") and "fun " + re.sub(r"^(?:<[^>]*>\s*)", "", raw), access, begin, last, doc)
            if body:
                pending[end] = ("code", None)
        elif word in ("val", "var"):
            found = re.match(r"(?:[\w<>?]+\.)?(\w+)\s*(:\s*.+)?$", head)
            if not found or code[: m.start()].count("(") - code[: m.start()].count(")") > 0:
                continue
            add("property", found[1], f"{word} {head}", access, begin, (code.find("\n", end) if code.find("\n", end) >= 0 else len(code)) - 1, doc)
            if body:
                pending[end] = ("code", None)
        elif word == "constructor" and scope:
            add("constructor", "constructor", _squeeze(f"constructor{head}"), access, begin, pairs[end] if body else end - 1, doc)
            if body:
                pending[end] = ("code", None)
        elif word == "typealias":
            stop = code.find("\n", m.end())
            full = _squeeze(code[m.end() : stop if stop >= 0 else len(code)])
            add("typealias", re.match(r"\w+", full)[0] if re.match(r"\w+", full) else full, f"typealias {full}", access, begin, (stop if stop >= 0 else len(code)) - 1, doc)
        elif word == "init" and body:
            pending[end] = ("code", None)
    return out


# Names that are no references where Kotlin asks for a type, and kinds of Kotlin symbols that can be a context.
_KOTLIN_PRIMITIVES = frozenset(("String", "Int", "Long", "Boolean", "Double", "Float", "Unit", "Any", "Nothing", "List", "Map", "Set"))
_KOTLIN_CONTEXTS = _KOTLIN_TYPES | {"function", "method", "test", "constructor"}
# Words that a declared name follows.
_DECLARES = frozenset("func fun class struct enum actor protocol interface object let var val case extension typealias associatedtype for catch package import precedencegroup operator".split())
_NOT_CODE = re.compile(r"^[ \t]*(?:@\w+[ \t]+)?(?:import|package)\b[^\n]*", re.M)
_NAME = re.compile(r"(\?\.|\.|::)?(?<!\w)(?:([A-Za-z_]\w*)|`([^`\n]+)`)(?=([ \t]*)([A-Za-z_]\w*|.)?)", re.S)
_KOTLIN_TYPE_PLACE = re.compile(r"(?:(?<!:):|<|\b(?:is|as|in|out)\??|\b(?:is|as)\?)\s*$|<[^<>(){};=]*,\s*$|:[^(){}=;\n]*(?:\([^()]*\))?\s*,\s*$")
_KOTLIN_HEADER = re.compile(r"\bfun\b[^(\n]*\(")
_CLOSURE = re.compile(r"\{\s*(?:\[[^\]]*\]\s*)?\(?([\w\s,]+?)\)?\s+in\b")
_PARAMETER = re.compile(r"(?<=[<,])\s*(\w+)")
_GENERIC_CLAUSE = re.compile(r"\b(?:func|struct|class|enum|actor|typealias)\s+\w+\s*<([^<>(){}]*)>|\binit\s*<([^<>(){}]*)>")


def _contexts(symbols: list[dict], lines: int) -> list[str | None]:
    """Name of the innermost declaration around each line, from 1; of equal ones that of the longest name."""
    out: list[str | None] = [None] * (lines + 2)
    for s in sorted(symbols, key=lambda s: (s["start_line"] - s["end_line"], len(s["qualified_name"]))):
        a, b = s["start_line"], min(s["end_line"], lines)
        out[a : b + 1] = [s["qualified_name"]] * max(0, b - a + 1)
    return out


def swift_references(code: str) -> Iterator[tuple[int, str]]:
    """Offset and name of what Swift code refers to: names in expressions, members (twice: as a member, and as the name it is made of) and
    types. Declared names, labels, parameters of closures, generic parameters and keywords are no references."""
    own = [m.span(1) for m in _CLOSURE.finditer(code)]
    for clause in _GENERIC_CLAUSE.finditer(code):
        own += [m.span(1) for m in _PARAMETER.finditer(code, *clause.span(1 if clause[1] is not None else 2))]
    own.sort()
    k, before, ended = 0, "", -1
    for m in _NAME.finditer(code):
        name = m[2] or m[3]
        follows = before if ended >= 0 and code[ended : m.start()].isspace() else ""
        before, ended = name, m.end()
        if m[1] == "." or m[1] == "?.":
            if name not in ("self", "Type"):
                yield from ((m.start(), name),) * 2
            continue
        if m[2] in _KEYWORDS or follows in _DECLARES or m[5] == ":" and not m[4]:
            continue
        while k < len(own) and own[k][1] <= m.start():
            k += 1
        if k < len(own) and own[k][0] <= m.start():
            continue
        if m[4] and m[5] and (m[5][0].isalpha() or m[5][0] == "_") and m[5] not in _KEYWORDS:
            continue  # a label ahead of the parameter's own name
        yield m.start(), name


def kotlin_references(code: str) -> Iterator[tuple[int, str]]:
    """Offset and name of what Kotlin code refers to: calls, members, and types but for twelve plain ones. Names that a function's head
    declares are no references, but the types of its receiver are."""
    heads = [(m.start(), m.end() - 1) for m in _KOTLIN_HEADER.finditer(code)]
    k, before, ended = 0, "", -1
    for m in _NAME.finditer(code):
        name = m[2] or m[3]
        follows = before if ended >= 0 and code[ended : m.start()].isspace() else ""
        before, ended = name, m.end()
        while k < len(heads) and heads[k][1] < m.start():
            k += 1
        if k < len(heads) and heads[k][0] <= m.start() < heads[k][1]:
            if m.end() < heads[k][1] and code[m.end() : heads[k][1]].strip() and name not in _KEYWORDS and name not in _KOTLIN_PRIMITIVES and len(name) > 1:
                yield m.start(), name
            continue
        if m[1]:
            if name not in ("class", "this"):
                yield m.start(), name
        elif m[2] in _KEYWORDS or follows in _DECLARES:
            continue
        elif m[5] == "(" and not m[4]:
            yield m.start(), name
        elif m[5] != ":" and name not in _KOTLIN_PRIMITIVES and _KOTLIN_TYPE_PLACE.search(code, code.rfind("\n", 0, m.start()) + 1, m.start()):
            yield m.start(), name


def references(text: str, symbols: list[dict], kotlin: bool = False) -> list[dict]:
    """Uses of names by the rules of the language, with the innermost declaration around them as context. Kotlin counts a name once a line
    and context; imports and packages refer to nothing."""
    code = _NOT_CODE.sub(lambda m: " " * len(m[0]), masked(text))
    starts = _line_table(text)
    around = _contexts([s for s in symbols if s["kind"] in _KOTLIN_CONTEXTS] if kotlin else symbols, len(starts))
    out, seen = [], set()
    for at, name in kotlin_references(code) if kotlin else swift_references(code):
        line = bisect_right(starts, at)
        if kotlin and (name, line) in seen:
            continue
        seen.add((name, line))
        out.append({"name": name, "start_line": line, "end_line": line, "context": around[line]})
    return out


SCANNERS = {"swift": swift_symbols, "kt": kotlin_symbols, "kts": kotlin_symbols}
_COLUMNS = "path string, kind string, name string, qualified_name string, signature string, enclosing_type string, access_level string, start_line int, end_line int, doc_comment string, estimated_tokens int"


_USES = "path string, name string, start_line int, end_line int, context string"


def scanned(files: DataFrame, symbols: bool = True, uses: bool = True) -> DataFrame:
    """X09/X10 over a table of files in one pass: rows of symbols and, with ``is_use``, of references. Symbol keys are unique, so that equal
    declarations on one line don't lose a file its symbols. Null contents give nothing."""
    fields = [*[c.split()[0] for c in _COLUMNS.split(", ")], "context", "is_use"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, t in zip(b["path"], b["content"]):
                text, ext = (t or "").replace("\r\n", "\n"), p.rsplit(".", 1)[-1].lower()
                found = SCANNERS[ext](text, p)
                if symbols:
                    rows += [{"path": p, "is_use": False} | s for s in {(s["qualified_name"], s["start_line"], s["end_line"]): s for s in reversed(found)}.values()]
                if uses:
                    rows += [{"path": p, "is_use": True} | r for r in references(text, found, ext != "swift")]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in fields})

    return files.filter(extension("path").isin(*SCANNERS)).select("path", "content").mapInPandas(scan, f"{_COLUMNS}, context string, is_use boolean")


def _symbols_of(found: DataFrame) -> DataFrame:
    return found.filter("not is_use").select(*[c.split()[0] for c in _COLUMNS.split(", ")])


def _uses_of(found: DataFrame) -> DataFrame:
    return found.filter("is_use").select(*[c.split()[0] for c in _USES.split(", ")])


def scanned_symbols(files: DataFrame) -> DataFrame:
    return _symbols_of(scanned(files, uses=False))


def scanned_references(files: DataFrame) -> DataFrame:
    """References of Swift and Kotlin files."""
    return _uses_of(scanned(files, symbols=False))


def file_fallback(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """The files without symbols, each as one symbol of kind ``file`` over all its lines."""
    bare = files.join(symbols.select("path").distinct(), "path", "left_anti")
    text = F.coalesce("content", F.lit(""))
    return bare.select(
        "path", F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("qualified_name"), F.concat(F.lit("File: "), "path").alias("signature"),
        F.lit(None).cast("string").alias("enclosing_type"), F.lit(None).cast("string").alias("access_level"), F.lit(1).alias("start_line"), F.size(split_lines(text)).alias("end_line"),
        F.lit(None).cast("string").alias("doc_comment"), token_estimate(text).cast("int").alias("estimated_tokens"),
    )


def extract(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols and references of current files, routed by extension, with the fallback for files that give none."""
    lines = regex_symbols(files).select(
        "path", "kind", "name", F.col("name").alias("qualified_name"), "signature", F.lit(None).cast("string").alias("enclosing_type"), F.lit(None).cast("string").alias("access_level"),
        F.col("line").alias("start_line"), F.col("line").alias("end_line"), F.lit(None).cast("string").alias("doc_comment"), F.col("tokens").cast("int").alias("estimated_tokens"),
    )
    ensure_checkpoint_dir(files.sparkSession)
    both = scanned(files).checkpoint()  # read for symbols, for the fallback and for references
    found = lines.unionByName(_symbols_of(both))
    return found.unionByName(file_fallback(files, found)), _uses_of(both)
