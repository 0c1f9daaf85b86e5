"""Problem 3: source files that nobody wrote by hand in their repository.

Evidence of a file, any of which is enough:

* ``copied``: most of its winnowed fingerprints occur in a known third-party file, or in at least ``MANY`` repositories of which its own
  is not the first to have had them, so that an original is kept apart from its copies and two forks don't accuse each other;
* ``notice``: a comment at its start or end is the notice of a third party, which is none that half of the repository's files bear;
  ``library_folder``: it lies in a package manager's folder for libraries, in the folder of one library;
* ``marked``: a comment at its start or end says that a tool emitted it; ``repetitive``: its lines repeat one pattern throughout;
* ``packed``: it was compressed for shipping; ``data``: its lines are literals; ``lockfile``: resolved dependencies.

Prose (md) and configuration (json that locks nothing) are never judged; style sheets only as packed, copied or noticed.
Null or empty contents have no evidence. Paths are the key; a null path is dropped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.lexing import comment_lines, fingerprints, lex, shape
from lodestone.operators.current import current_files, repository_of
from lodestone.operators.skew import skew_join
from lodestone.session import ensure_checkpoint_dir

#: Tokens of a fingerprint and k-grams of a winnowing window: stretches of K + WINDOW - 1 tokens are always found.
K, WINDOW = 32, 16
#: Share of a file's fingerprints that must recur elsewhere, and repositories that must have one for it to recur among unrelated ones.
COPIED, MANY = 0.5, 3
#: Share of a repository's files that bear the same notice from which on it is the repository's own.
OWN_NOTICE = 0.5
#: Shares of lines are judged by themselves and by the lower end of their confidence interval, which is what short files are held to.
REPETITIVE, SURELY_REPETITIVE, VARIETY, DATA, SURELY_DATA = 0.45, 0.35, 0.3, 0.65, 0.45
#: Standard deviations of that interval.
SURE = 1.96
#: Fingerprints that recur are told from others by so many bits before they travel back to their files.
BUCKETS = 1 << 20
#: Stands for an unknown time of modification, after all others.
LAST = (1 << 62) + 1
REASONS = ("marked", "repetitive", "packed", "data", "lockfile", "notice", "library_folder", "copied")
_BIT = {r: 1 << i for i, r in enumerate(REASONS)}

PROSE, CONFIG, STYLE = {"md", "markdown", "txt", "rst"}, {"json", "jsonc", "yaml", "yml", "toml", "lock"}, {"css", "scss", "less"}

#: What tools write at the start of a comment line to say that they emitted the file.
_MARK = re.compile(
    r"""^(?:
      @generated\b | <auto-?generated\b | auto-?generated\b(?!\s+(?:method|stub|constructor|getter|setter|catch))
    | (?:this\ (?:file|code|source)\ (?:was|is|has\ been)\ )?(?:auto(?:matically)?[\ -]?)?(?:generated|produced|created|emitted|written)\ (?:automatically|by|using|from|with|via)\b.*
    | (?:code|file|source)\ generated\ (?:by|from|using|with)\b | this\ file\ was\ (?:produced|generated|emitted)\b
    | (?:-\*-\s*|this\ is\ (?:a|an)\ )?machine[\ -](?:output|generated|written)\b
    | (?:!+\s*)?built\ by\ .*\bedit\b.*\binstead\b
    | do\ not\ (?:edit|modify|change|touch)\b(?:\ (?:by\ hand|manually|this\ file|directly)\b|\s*[.!:;-]|\s*$)
    | begin\ \S+\ output\b
    | source:\ \S+\.(?:idl|proto|thrift|fbs|avsc|graphql|xsd|wsdl|g4|y|l|schema)\b
    | .*\ -\ (?:emitted|generated|produced)\ by\ \w+
    | .*\bchanges\ (?:will|would)\ be\ (?:lost|overwritten)\b
    | (?:diese\ datei\ wurde\ )?automatisch\ (?:erzeugt|generiert|erstellt)\b | diese\ datei\ wurde\ (?:automatisch|maschinell|von)\b
    | (?:ce\ )?fichier\ (?:produit|généré|genere|créé)\b | .*\bne\ pas\ (?:modifier|éditer)\b
    | (?:este\ )?(?:archivo|fichero)\ (?:fue\ )?(?:generado|producido|creado)\b | .*\bgenerado\ automáticamente\b | no\ (?:editar|modificar)\b
    | (?:este\ )?arquivo\ (?:foi\ )?(?:gerado|produzido)\b | .*\bgerado\ automaticamente\b | não\ (?:edite|editar|modifique)\b
    | .*(?:自動生成|自動的に生成|編集しないで|自动生成|请勿编辑)
    )""",
    re.I | re.X,
)
_NOTICE = re.compile(
    r"copyright\s*(?:\(c\)|©|\d{4})|©\s*\d{4}|spdx-license-identifier|(?:released|licen[sc]ed|distributed|available)\s+(?:under|with permission|subject)|\blibrary, version\b|\bsee licen[sc]e[.\w-]*|all rights reserved",
    re.I,
)
_WORKSPACE = re.compile(r"^part of the workspace\b", re.I)
_OWN = re.compile(r"internal use only|confidential", re.I)
# Folders into which package managers and checkouts put one folder a library.
LIBRARY_FOLDERS = ("third_party", "third-party", "thirdparty", "3rdparty", "node_modules", "bower_components", "external", "externals", "Pods", "Checkouts", "deps", "vendor", "vendored", "site-packages")
_LIBRARY = re.compile(r"/(?:" + "|".join(LIBRARY_FOLDERS) + r")/(?!src/|lib/|test)[^/]+/[^/]+(?:/[^/]+)*$", re.I)
#: Source roots: below one, a folder named vendor is a part of the project's own structure.
_OWN_ROOT = re.compile(r"/(?:src|sources|tests?|docs?|config|tools|js|css)/", re.I)
# What lock files of package managers hold: keys of which two are needed, and signs of which one is.
_LOCK = re.compile(r"""(?m)^[ \t]*["']?(?:integrity|resolved|pins|checksum|resolution)["']?\s*[:=]|[{,]\s*"(?:integrity|resolved|pins|checksum)"\s*:""")
_LOCK_SIGN = re.compile(r"""(?m)["']?\block(?:file)?[-_]?version["']?\s*[:=]|^#.*\byarn lockfile|^PODFILE CHECKSUM:|^GEM\n {2}remote:|^["']?content-hash["']?\s*[:=]|^\[\[package\]\]\n(?:.*\n)*?(?:checksum|source) =""", re.I)
_COMMENT = re.compile(r"^\s*(?:///?|//!|/\*+!?|\*+/?|#+!?|<!--|--|\"\"\"|''')\s?(.*?)\s*(?:\*+/|-->)?\s*$")


def outer_comments(text: str) -> list[str]:
    """Texts of the comment lines ahead of the first line of code and behind the last."""
    lines = [x for x in text.splitlines() if x.strip()]
    out: list[str] = []
    for part in (lines, lines[::-1]):
        for line in part:
            m = _COMMENT.match(line)
            if not m:
                break
            out.append(m[1].strip(" -=*#/"))
        if len(out) >= len(lines):  # nothing but comments
            break
    return [x for x in out if x]


def library_folder(path: str) -> bool:
    """Whether the path lies in <library folder>/<library>/; not where the folder is a module below a source root."""
    m = _LIBRARY.search(path)
    return bool(m) and not _OWN_ROOT.search(path[: m.start() + 1])


def surely(share: float, n: int) -> float:
    """Lower end of the confidence interval of a share of n (Wilson's score)."""
    if not n:
        return 0.0
    z = SURE * SURE / n
    return (share + z / 2 - SURE * (share * (1 - share) / n + z / (4 * n)) ** 0.5) / (1 + z)


def evidence(path: str, text: str) -> tuple[int, list[int], str]:
    """Bits of ``REASONS`` that the file alone gives, its fingerprints, and the first foreign notice, without numbers."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    bits = 0
    if not text.strip() or ext in PROSE:
        return 0, [], ""
    if ext in CONFIG:
        return (_BIT["lockfile"] if _LOCK_SIGN.search(text) or len(_LOCK.findall(text)) >= 2 else 0), [], ""
    x = lex(text)
    comment = comment_lines(x, ext in {"py", "sh", "rb", "yaml", "pl"})
    s = shape(x, comment)
    head = outer_comments(text)
    notice = ""
    own = re.compile(r"(?<![\w-])" + re.escape(path.split("/", 1)[0]) + r"(?![\w-])", re.I)
    for line in head:
        if ext not in STYLE and _MARK.match(line):
            bits |= _BIT["marked"]
        if _WORKSPACE.match(line) or (_NOTICE.search(line) and not own.search(line) and not _OWN.search(line)):
            bits |= _BIT["notice"]
            notice = notice or re.sub(r"[\W\d_]+", " ", line.lower()).strip()
    if library_folder("/" + path.split("/", 1)[-1]):
        bits |= _BIT["library_folder"]
    if s.space_share < 0.07 and s.mean_line >= 110:
        bits |= _BIT["packed"]
    if ext not in STYLE:
        if s.period >= REPETITIVE and s.variety < VARIETY and surely(s.period, s.code_lines) >= SURELY_REPETITIVE:
            bits |= _BIT["repetitive"]
        if s.data_lines >= DATA and surely(s.data_lines, s.code_lines) >= SURELY_DATA:
            bits |= _BIT["data"]
    return bits, fingerprints(x, ~comment, K, WINDOW).tolist(), notice


_EVIDENCE = "pid bigint, repo bigint, since bigint, known boolean, bits int, prints array<bigint>, notice bigint"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        found = [evidence(p, t or "") for p, t in zip(b["path"], b["content"])]
        hashes = [int.from_bytes(hashlib.blake2b(x[2].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True) if x[2] else None for x in found]
        yield pd.DataFrame({"pid": b["pid"], "repo": b["repo"], "since": b["since"].astype("Int64").mask(b["known"]), "known": b["known"], "bits": [x[0] for x in found], "prints": [x[1] for x in found], "notice": pd.Series(hashes, dtype="Int64", index=b.index)})


def _bucket() -> Column:
    return F.pmod(F.xxhash64("print"), F.lit(BUCKETS)).alias("bucket")


def _among(rows: DataFrame, prints: DataFrame) -> DataFrame:
    """Rows whose ``print`` can be among some prints, told by a bitmap of ``BUCKETS`` numbers; the rest needs no shuffle."""
    return rows.withColumn("bucket", _bucket()).join(F.broadcast(prints.select(_bucket()).distinct()), "bucket", "left_semi").drop("bucket")


def recurring_prints(rows: DataFrame) -> DataFrame:
    """Fingerprints that are third-party ones: ``print, first``: in a known file (``first`` is null), or in ``MANY`` repositories, of which
    ``first`` is the one that had it first.

    Counted in two steps, a repository once a fingerprint first, so that text which all files share is reduced on the map side. The
    first repository is sought for those that recur only. Known files have no time.
    """
    each = rows.groupBy("print", "repo").agg(F.min("since").alias("since"))
    repos = each.groupBy("print").agg(F.count("*").alias("repos"), F.count("since").alias("dated"))
    recurring = repos.filter((F.col("dated") < F.col("repos")) | (F.col("repos") >= MANY))
    first = _among(each, recurring).groupBy("print").agg(F.count("*").alias("repos"), F.count("since").alias("dated"), F.min_by("repo", F.struct("since", "repo")).alias("first"))
    third = first.filter((F.col("dated") < F.col("repos")) | (F.col("repos") >= MANY))
    return third.select("print", F.when(F.col("dated") == F.col("repos"), F.col("first")).alias("first"))


def provenance(files: DataFrame, upstream: DataFrame) -> DataFrame:
    """``path``, ``reasons`` and ``recurring_share`` of every current file; no reasons: written by hand.

    Files travel once. Their evidence is narrow and written, as it is read more than once. Fingerprints travel to be counted by
    repository; of the rows, only those whose fingerprint may recur (by a bitmap of ``BUCKETS`` numbers) travel back to their file, and the
    frequent ones among them are spread. A file that was modified at an unknown time counts as the last. ``pid`` is a 64-bit hash of
    the path.
    """
    ensure_checkpoint_dir(files.sparkSession)
    current = current_files(files, ["path", "content", "modified_at"]).select(
        F.xxhash64("path").alias("pid"), F.xxhash64(repository_of("path")).alias("repo"), F.coalesce(F.unix_micros(F.col("modified_at").cast("timestamp")), F.lit(LAST)).alias("since"), "path", "content", F.lit(False).alias("known")
    )
    known = upstream.select(
        F.lit(0).cast("bigint").alias("pid"),
        F.xxhash64(F.concat(F.lit("library:"), F.coalesce("library", F.lit("")))).alias("repo"),
        F.lit(LAST).alias("since"),
        F.concat(F.lit("library/"), F.coalesce("upstream_path", F.lit(""))).alias("path"),
        "content",
        F.lit(True).alias("known"),
    )
    judged = current.unionByName(known).mapInPandas(_judge, _EVIDENCE).checkpoint()
    own = judged.filter("not known")
    recurring = recurring_prints(judged.select("repo", "since", F.explode("prints").alias("print")))
    maybe = _among(own.select("pid", "repo", F.explode("prints").alias("print")), recurring)
    met = skew_join(maybe, recurring, ["print"], "inner").filter("first is null or first <> repo")
    shared = met.groupBy("pid").agg(F.count("*").alias("shared"))
    # A notice that most of a repository's files bear is its own.
    sizes = own.groupBy("repo").agg(F.count("*").alias("files"))
    bearers = own.filter("notice is not null").groupBy("repo", "notice").agg(F.count("*").alias("bearers")).join(sizes, "repo")
    its_own = bearers.filter(F.col("bearers") >= OWN_NOTICE * F.col("files")).select("repo", "notice", F.lit(True).alias("its_own"))
    files_ = skew_join(own.select("pid", "repo", "notice", "bits", F.size("prints").alias("prints")), its_own, ["repo", "notice"])
    noticed = F.when(F.col("its_own"), F.col("bits").bitwiseAND(~_BIT["notice"])).otherwise(F.col("bits"))
    share = F.when(F.col("prints") > 0, F.coalesce("shared", F.lit(0)) / F.col("prints")).otherwise(F.lit(0.0))
    per_file = files_.join(shared, "pid", "left").select("pid", noticed.alias("bits"), share.alias("recurring_share"))
    bits = F.col("bits") + F.when(F.col("recurring_share") >= COPIED, F.lit(_BIT["copied"])).otherwise(F.lit(0))
    named = F.array_compact(F.array(*[F.when(bits.bitwiseAND(_BIT[r]) > 0, F.lit(r)) for r in REASONS]))
    paths = files.select("path").filter("path is not null").distinct().withColumn("pid", F.xxhash64("path"))
    return per_file.join(paths, "pid").select("path", named.alias("reasons"), F.round("recurring_share", 6).alias("recurring_share"))
