"""Parsing-expression grammars of function declarations, one per language, over lexical tokens that keep their offsets.

A declaration is parsed from where its documentation ends (or, in Python, from its decorators on). Tokens are made only as far as the
declaration's head reaches. What a grammar gives is the function's name and where its signature starts and ends.

    Function  <- Before* (Keyword form / typed form / assigned form)
    Params    <- '(' Inside* ')'          Inside <- '(' Inside* ')' / '[' Inside* ']' / '{' Inside* '}' / any other token but a closer
    Generics  <- '<' (Generics / any token but '>')* '>'
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from lodestone.llm.packrat import Result, Rule, Token, absent, action, choice, many, optional, remembered, sequence, token

_LEX = re.compile(
    r"""(?P<skip>[^\S\n]+|\\\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)
      | (?P<line>\n)
      | (?P<word>[^\W\d][\w$]*|\$[\w$]*)
      | (?P<quoted>`[^`\n]*`)
      | (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)')
      | (?P<number>\d[\w.]*)
      | (?P<sign>->|=>|::|\.\.\.|[^\s\w])""",
    re.X,
)
# Words of the languages that tell declarations from each other.
KEYWORDS = frozenset(
    """func init subscript deinit fun constructor def function fn async export default const let var class struct enum interface trait impl protocol actor object extension type typealias
    import package return if for while switch guard throws rethrows where get set new await yield static case""".split()
)
MODIFIERS = frozenset(
    """public private protected internal fileprivate open static final override abstract virtual inline mutating nonmutating nonisolated isolated required convenience class suspend operator infix prefix postfix
    tailrec external expect actual synchronized native strictfp default transient volatile async unsafe extern const export declare readonly get set lateinit data sealed inner companion pub crate
    constexpr explicit friend noexcept partial sealed indirect dynamic optional lazy weak unowned implicit accessor""".split()
)
_OPEN, _CLOSE = ("(", "[", "{"), (")", "]", "}")


class Function(NamedTuple):
    name: str
    start: int  # offsets of the signature
    end: int


def tokens_from(text: str, at: int) -> list[Token]:
    """Lexical tokens from an offset to the end of a declaration's head: a brace or semicolon outside brackets, or an empty line."""
    out: list[Token] = []
    depth = 0
    while (m := _LEX.match(text, at)) is not None:
        at = m.end()
        kind = m.lastgroup
        if kind == "skip":
            continue
        s = m[0]
        if kind == "line":
            if depth <= 0:
                if out and out[-1].kind == "line":
                    break
                out.append(Token("line", m.start(), at, 0, 0))
            continue
        if kind == "word" and s in KEYWORDS:
            kind = s
        elif kind == "sign":
            kind = s
            if s in _OPEN:
                depth += 1
            elif s in _CLOSE:
                depth -= 1
                if depth < 0:
                    break
        out.append(Token(kind, m.start(), at, 0, 0))
        if depth <= 0 and s == ";" or depth == 1 and s == "{" and not any(t.kind == "=" for t in out[-3:]):
            break
    return out


def other_than(*kinds: str) -> Rule:
    barred = frozenset(kinds)
    return lambda t, i, m: (t[i], i + 1) if i < len(t) and t[i].kind not in barred else None


def lazily(rule: Callable[[], Rule]) -> Rule:
    return remembered(lambda t, i, m: rule()(t, i, m))


def word(*texts: str) -> Rule:
    return token(*texts)


_Line = many(token("line"))
_Inside = lazily(lambda: choice(sequence(token("("), many(_Inside), token(")")), sequence(token("["), many(_Inside), token("]")), sequence(token("{"), many(_Inside), token("}")), other_than(*_OPEN, *_CLOSE)))
_Params = sequence(token("("), many(_Inside), token(")"))
_Generics = lazily(lambda: sequence(token("<"), many(choice(_Generics, _Params, other_than("<", ">", "{", ";"))), token(">")))
_Name = token("word", "quoted", "get", "set", "type", "object", "default", "case", "async", "init")
_Sign = many(token(*"+-*/%<>=!&|^~?.", "->", "..."), 1)
_Angle = optional(_Generics)
_Attribute = sequence(choice(token("@"), sequence(token("#"), optional(token("!")))), optional(sequence(token("word"), many(sequence(token(".", ":"), _Name)))), optional(choice(_Params, sequence(token("["), many(_Inside), token("]")))), _Line)


def _modifier(tokens: object, i: int, m: dict) -> Result:
    t = tokens[i] if i < len(tokens) else None
    if t is None or t.kind not in ("word", "static", "class", "const", "export", "default", "async", "get", "set") or m["text"][t.start : t.end] not in MODIFIERS:
        return None
    after = _Params(tokens, i + 1, m)  # private(set), pub(crate)
    at = after[1] if after is not None else i + 1
    following = tokens[at].kind if at < len(tokens) else ""
    if t.kind == "const" and at + 1 < len(tokens) and tokens[at + 1].kind in ("=", ":"):
        return None  # a value
    return None if following in ("(", "=", ":", "") or after is not None and following in ("{", "->", ";", "line") else (t, at)


_Before = many(choice(_Attribute, remembered(_modifier), token("line")))
# A type: a name with its parts, generics, arrays, pointers and marks.
_Type = lazily(lambda: sequence(many(token("&", "*", "word_mark")), choice(sequence(_Name, _Angle, many(sequence(token(".", "::"), _Name, _Angle))), _Params, sequence(token("["), many(_Inside), token("]"))), many(choice(token("?", "!", "*", "&", "..."), sequence(token("["), many(_Inside), token("]"))))))
_Returned = optional(sequence(_Line, token("->", ":"), many(choice(_Params, _Generics, sequence(token("["), many(_Inside), token("]")), other_than("{", ";", "=", "=>", "line", "where", *_OPEN, *_CLOSE)), 1)))
_Effects = many(sequence(_Line, token("async", "throws", "rethrows", "const"), optional(_Params)))
_Where = optional(sequence(_Line, token("where"), many(other_than("{", ";"))))
_Throws = optional(sequence(_Line, token("throws"), many(other_than("{", ";", "line"))))


def _named(i: int) -> Callable[[list], tuple]:
    return lambda v: v[i] if isinstance(v[i], Token) else v[i][0]


# Swift: func name<T>(…) async throws -> T where …, init?(…), subscript(…) -> T
_Swift = choice(
    action(sequence(token("func"), choice(_Name, _Sign), _Angle, _Params, _Effects, _Returned, _Where), lambda v: v[1]),
    action(sequence(token("init", "subscript"), optional(token("?", "!")), _Angle, _Params, _Effects, _Returned, _Where), _named(0)),
    action(sequence(token("deinit"), absent(token("("))), _named(0)),
)
# Kotlin: fun <T> Receiver.name(…): T where …, constructor(…)
_Receiver = optional(sequence(choice(_Params, sequence(_Name, _Angle, many(token("?")))), many(sequence(token("."), _Name, _Angle, many(token("?")), absent(token("(")))), token(".")))
_Kotlin = choice(
    action(sequence(token("fun"), _Angle, _Receiver, _Name, _Angle, _Params, _Returned, _Where), _named(3)),
    action(sequence(token("fun"), _Angle, _Name, _Params, _Returned, _Where), _named(2)),
    action(sequence(token("constructor"), _Params), _named(0)),
)
# Java, C#, C, C++: <T> Type name(…) throws …; a constructor has no type.
_Typed = choice(
    action(sequence(_Angle, many(sequence(_Type, absent(_Params)), 1), _Name, many(sequence(token("::"), _Name)), _Angle, _Params, _Throws), lambda v: v[3][-1][1] if v[3] else v[2]),
    action(sequence(_Angle, _Name, _Params, _Throws), _named(1)),
)
# JavaScript, TypeScript: function* name(…): T, const name = (…) => …, name(…) { … } in a class.
_Arrow = choice(sequence(_Angle, _Params, _Returned, token("=>")), sequence(_Name, token("=>")), sequence(token("function"), optional(token("*")), optional(_Name), _Params))
_Script = choice(
    action(sequence(token("function"), optional(token("*")), _Name, _Angle, _Params, _Returned), _named(2)),
    action(sequence(token("const", "let", "var"), _Name, optional(sequence(token(":"), many(other_than("=", "{", ";"), 1))), token("="), optional(token("async")), _Arrow), _named(1)),
    action(sequence(token("constructor"), _Params), _named(0)),
    action(sequence(optional(token("*", "#")), _Name, optional(sequence(token("="), optional(token("async")), absent(token("word")))), _Angle, _Params, _Returned), _named(1)),
)
# Go: func (r *T) Name[T any](…) (…)
_Go = action(sequence(token("func"), optional(_Params), _Name, optional(sequence(token("["), many(_Inside), token("]"))), _Params, optional(choice(_Params, _Type))), _named(2))
# Rust: fn name<T>(…) -> T where …
_Rust = action(sequence(many(token("string")), token("fn"), _Name, _Angle, _Params, _Returned, _Where), _named(2))
# Python, Scala, Ruby: def name(…) -> T
_Def = action(sequence(token("def"), _Name, choice(sequence(token("["), many(_Inside), token("]")), _Angle), optional(_Params), optional(sequence(token("->"), many(choice(sequence(token("["), many(_Inside), token("]")), other_than(":", "line", "=", "{")), 1)))), _named(1))
_Any = choice(_Swift, _Kotlin, _Rust, _Def, _Script, _Typed)

_BY_EXTENSION: dict[str, Rule] = (
    {"swift": _Swift, "go": _Go, "rs": _Rust, "py": _Def, "pyi": _Def, "pyw": _Def, "scala": _Def, "rb": _Def}
    | dict.fromkeys(("kt", "kts"), _Kotlin)
    | dict.fromkeys(("java", "cs", "c", "h", "cc", "cpp", "hpp", "m", "mm", "groovy"), _Typed)
    | dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "tsx", "mts", "cts"), _Script)
)
PYTHON = ("py", "pyi", "pyw")


def function_at(text: str, at: int, ext: str) -> Function | None:
    """The function declared at an offset, if the language's grammar finds one; a language without a grammar is tried by all."""
    tokens = tokens_from(text, at)
    memo: dict = {"text": text}
    before = _Before(tokens, 0, memo)
    i = before[1] if before is not None else 0
    found = _BY_EXTENSION.get(ext, _Any)(tokens, i, memo)
    if found is None or found[0] is None:
        return None
    end = found[1] - 1
    while end > 0 and tokens[end].kind in ("line", "=>", ";"):
        end -= 1
    first = next((k for k in range(i) if tokens[k].kind not in ("line", "@") and not _attribute_ends_after(tokens, k, memo)), i)
    name = found[0] if isinstance(found[0], list) else [found[0]]
    return Function(text[name[0].start : name[-1].end].strip("`"), tokens[first].start, tokens[end].end)


def _attribute_ends_after(tokens: list[Token], k: int, memo: dict) -> bool:
    """Whether a token lies in an attribute that opens at or before it."""
    j = 0
    while j <= k:
        a = _Attribute(tokens, j, memo)
        if a is not None and a[1] > k:
            return True
        j = a[1] if a is not None else j + 1
    return False
