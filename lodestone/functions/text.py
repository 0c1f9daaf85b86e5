"""Scalar text functions as Catalyst expressions.

All of them give null for a null text unless they say otherwise, and take texts of any length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that end a line for the index, each on its own, so that CRLF gives an extra empty line.
LINE_BREAK = r"[\n\x0B\f\r\u0085  ]"
# White space that trimming removes inside a line (tab and all separators).
LINE_SPACE = r"[\t\p{Z}]"
# Words that are too common in code to be a topic.
TOPIC_STOP_WORDS = (
    "the", "and", "func", "struct", "class", "var", "let", "return", "if", "else", "for", "in", "import", "public",
    "private", "extension", "case", "enum",
)
# Fence names by extension; swift and kotlin come from the language.
FENCES = {"js": "javascript", "ts": "typescript", "py": "python", "java": "java", "html": "html", "css": "css", "json": "json", "md": "markdown"}
#: Buckets of the proxy vector.
VECTOR_SIZE = 128


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def content_hash(text: Column | str) -> Column:
    """Lower-case hexadecimal SHA-256 of the UTF-8 bytes."""
    return F.sha2(_c(text).cast("binary"), 256)


def byte_size(text: Column | str) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(_c(text)).cast("bigint")


def split_lines(text: Column | str) -> Column:
    """Lines as the index counts them; an empty text is one empty line."""
    return F.split(_c(text), LINE_BREAK, -1)


def source_lines(text: Column | str) -> Column:
    """Lines where LF and CRLF each end one, as symbols number them."""
    return F.split(_c(text), "\r?\n", -1)


def trim_line(text: Column | str) -> Column:
    return F.regexp_replace(_c(text), rf"^{LINE_SPACE}+|{LINE_SPACE}+$", "")


def line_metrics(text: Column | str) -> Column:
    """Struct of doc_lines (start with ``//``) and code_lines (other non-blank lines); blank lines count nowhere."""
    lines = F.transform(split_lines(text), trim_line)
    used = F.filter(lines, lambda x: x != "")
    doc = F.size(F.filter(used, lambda x: x.startswith("//")))
    return F.struct(doc.alias("doc_lines"), (F.size(used) - doc).alias("code_lines"))


def extension(path: Column | str) -> Column:
    """Lower-cased extension of the last path part, or ''."""
    return F.lower(F.regexp_extract(_c(path), r"\.([^./]+)$", 1))


def language_of(path: Column | str) -> Column:
    """Swift and kotlin by name, any other language by its extension."""
    e = extension(path)
    return F.when(e.isin("kt", "kts"), F.lit("kotlin")).otherwise(e)


def fence_of(path: Column | str) -> Column:
    """Name for a Markdown code fence, '' if there is none."""
    lang = language_of(path)
    out = F.when(lang.isin("swift", "kotlin"), lang)
    for ext, fence in FENCES.items():
        out = out.when(lang == ext, F.lit(fence))
    return out.otherwise(F.lit(""))


def body_by_range(text: Column | str, start: Column | str, end: Column | str) -> Column:
    """Lines start..end (1-based, clipped to the text) joined by LF; '' if the range lies outside or is empty."""
    return body_of_lines(split_lines(text), start, end)


def body_of_lines(lines: Column | str, start: Column | str, end: Column | str) -> Column:
    """T09 on lines that were split before, for many ranges of one text."""
    x = _c(lines)
    first = F.greatest(F.lit(1), _c(start))
    last = F.least(F.size(x), _c(end))
    return F.when(first > last, F.lit("")).otherwise(F.array_join(F.slice(x, first, F.greatest(F.lit(0), last - first + 1)), "\n"))


def symbol_text(lines: Column | str, start: Column | str, end: Column | str) -> Column:
    """Text of a symbol from ``source_lines``: lines start..end joined by LF, without spaces, tabs and line ends around.

    Null lines (no current file), null bounds and ranges outside the file give ''.
    """
    first = F.greatest(F.lit(1), _c(start))
    last = F.least(F.size(_c(lines)), _c(end))
    body = F.array_join(F.slice(_c(lines), first, F.greatest(F.lit(0), last - first + 1)), "\n")
    return F.coalesce(F.when(first <= last, F.btrim(body, F.lit(" \t\r\n"))), F.lit(""))


def clean_identifier(text: Column | str) -> Column:
    """Without white space around it and without one pair of backticks."""
    return F.regexp_replace(F.regexp_replace(_c(text), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), "^`(.*)`$", "$1")


def topic_words(text: Column | str) -> Column:
    """Words that can be a topic: lower case, letters and digits, longer than three, not in the stop list."""
    words = F.split(F.lower(_c(text)), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*TOPIC_STOP_WORDS))


def complexity(text: Column | str) -> Column:
    """Ten times distinct words per word, plus characters / 5000."""
    words = F.filter(F.split(F.lower(_c(text)), r"\s+"), lambda w: w != "")
    return F.lit(10.0) * F.size(F.array_distinct(words)) / F.greatest(F.lit(1), F.size(words)) + F.length(_c(text)) / F.lit(5000.0)


def word_bucket(word: Column) -> Column:
    """Reproducible bucket of a word for the proxy vector: first 32 bits of its MD5 modulo the vector's size."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % VECTOR_SIZE


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for vectors of unequal length."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a vector is all zero or the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def map_entry(path: Column, name: Column, signature: Column, start: Column, end: Column, doc: Column) -> Column:
    """Documentation lines, then ``file: signature [Ls-Le]``, without the file where the name is the file's own."""
    base = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", "")
    head = F.when(F.lower(base) == F.lower(name), F.lit("")).otherwise(F.concat(F.regexp_extract(path, r"([^/]+)$", 1), F.lit(": ")))
    docs = F.when(F.coalesce(doc, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit("/// "), F.regexp_replace(doc, "\n", "\n/// "), F.lit("\n")))
    return F.concat(docs, head, F.coalesce(signature, name), F.lit(" [L"), start.cast("string"), F.lit("-L"), end.cast("string"), F.lit("]"))


def content_prefix(text: Column | str, chars: int = 2000) -> Column:
    """First characters of a content."""
    return F.substring(_c(text), 1, chars)


def html_escape(text: Column | str) -> Column:
    """& < > " ' as entities."""
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, _c(text))


def module_title(path: Column | str) -> Column:
    """First path part that is neither Sources nor Tests, and the file name."""
    parts = F.filter(F.split(_c(path), "/"), lambda x: ~x.isin("Sources", "Tests", ""))
    return F.concat_ws(" / ", F.try_element_at(parts, F.lit(1)), F.regexp_extract(_c(path), r"([^/]+)$", 1))
