"""Relations of the index (R1-R8, R11) as explicit Spark schemas, and the kind vocabulary of symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in pairs])


_S, _I, _L, _TS, _D = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampNTZType(), T.DoubleType()

#: One row per indexing of a file.
FILES = _fields(("path", _S), ("language", _S), ("sha256", _S), ("size_bytes", _L), ("modified_at", _TS), ("indexed_at", _TS), ("doc_lines", _I), ("code_lines", _I), ("content", _S))
#: R2: key (path, qualified_name, start_line, end_line).
SYMBOLS = _fields(("path", _S), ("kind", _S), ("name", _S), ("qualified_name", _S), ("signature", _S), ("enclosing_type", _S), ("access_level", _S), ("start_line", _I), ("end_line", _I), ("doc_comment", _S), ("estimated_tokens", _I))
#: Uses of names, without a key.
SYMBOL_REFS = _fields(("path", _S), ("name", _S), ("start_line", _I), ("end_line", _I), ("context", _S))
#: R4
FAVORITES = _fields(("name", _S), ("file_path", _S), ("kind", _S), ("view_mode", _S), ("created_at", _TS))
#: R5 with R6 nested.
PACK_ITEM = _fields(("path", _S), ("kind", _S), ("reason", _S))
PACKS = _fields(("name", _S), ("description", _S), ("created_at", _TS), ("items", T.ArrayType(PACK_ITEM)))
#: R7
ACTIONS = _fields(("id", _L), ("prompt", _S), ("tool_name", _S), ("type", _S), ("tokens_used", _I), ("duration_ms", _I), ("status", _S), ("ts", _TS), ("response", _S))
#: What the vector index holds.
CHUNKS = _fields(("text", _S), ("metadata", T.MapType(_S, _S)), ("vector", T.ArrayType(T.FloatType())))
#: R11
LINKS = _fields(("source", _S), ("target", _S), ("strength", _D))
#: R13
HISTORY = _fields(("cycle", _I), ("hash", _S), ("message", _S), ("total_files", _I), ("naive_tokens", _L), ("map_tokens", _L), ("focus_preserved", T.BooleanType()), ("compression_ratio", _D))

# The kinds a symbol can have. Any other text counts as ``function``.
KINDS = (
    "struct", "class", "actor", "enum", "protocol", "interface", "extension", "function", "method", "initializer",
    "property", "test", "file", "style", "case", "object", "companion", "dataClass", "sealedClass", "valueClass",
    "typealias", "constructor", "enumEntry",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; a Parquet file or a folder of them."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
