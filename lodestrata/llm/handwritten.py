"""Files that nobody wrote by hand: generated, minified or bundled, vendored, or data stored as code.

A random forest is trained on compression ratio, token entropy, identifier lengths, comment density and the like. Its
labels come from what a file says of itself and features do not see: notices of tools in the header and banners (cut out
of the text before features are taken) and the name endings of packed scripts. A file is a case if its header or place
says so, which holds even where the code looks hand-written, if the whole file is one literal, or if the forest finds it
so by its looks alone.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm import lexing
from lodestrata.storage import materialize

# Folder names that hold third-party or tool-written files, as whole path parts.
PLACES = [
    "node_modules", "bower_components", "jspm_packages", "site-packages", "dist-packages", "vendor", "_vendor", "vendored", "third_party",
    "third-party", "thirdparty", "3rdparty", "extern", "external", "externals", "deps", "__generated__", "generated", "_generated", "autogen",
    "gen", "dist", "__pycache__",
]
# Name endings that tools give to their output.
SUFFIXES = r"(?i)(?:[._-]min|[._-]bundle|[._-]chunk|\.prod|\.gen|\.g|\.generated|_generated|\.pb|\.pb\.gw|_pb2|_pb2_grpc|_grpc_pb|\.designer|\.freezed|\.umd)\.[a-z]{1,4}$"
PACKED = r"(?i)[._-](?:min|bundle|chunk|umd)\.[cm]?js$"
# What headers of tool-written files and of copies say, and what takes it back.
_WRITTEN = re.compile(
    r"auto[\s_-]?(?:matically[\s_-])?gen|@generated|\bcode generated\b|\bgenerated (?:automatically )?(?:by|from|with|using|via|on)\b|\bmachine[- ]generated\b"
    r"|\bdo(?: not|n't) (?:edit|modify|change|touch)\b(?=\W*$|[.!,;:)*-]| (?:this|it|them|manually|directly|by hand|here|the (?:file|output|contents?|generated))\b)|\b(?:edits?|changes|modifications)\b.{0,20}\b(?:overwritten|lost|discarded|clobbered)\b"
    r"|\binstead of editing\b|\b(?:built|compiled|produced|emitted|created|written)\b.{0,30}\bby (?:tools?/|the .{0,20}(?:tool|compiler|generator))|\bthis file (?:is|was) (?:produced|created|built|compiled|emitted)\b",
    re.I,
)
_COPIED = re.compile(
    r"\b(?:bundled|vendored|verbatim|unmodified|embedded) (?:copy|version)\b|\bcopied (?:verbatim )?from\b|\bvendored (?:from|in)\b|\bupstream:|\bsee upstream\b"
    r"|\bbelongs? upstream\b|\bimported (?:unchanged|verbatim|unmodified|as is)\b|\bimported from (?:upstream|the upstream|https?:|github|[\w./@-]+ v?\d)|\b(?:third|3rd)[- ]party (?:code|file|copy|library)\b",
    re.I,
)
_TAKEN_BACK = re.compile(r"\bused to be\b|\bno longer\b|(?<!edit )(?<!modify )(?<!change )(?<!touch )\bby hand\b|\b(?:writ|read|emit|load|check|pars|render|compar|format|handl|return|consum|process|validat)(?:es|s)? (?:\w+ ){0,2}generated\b|\bhand[- ](?:written|maintained|edited|rolled)\b|\bnot (?:auto[- ]?)?generated\b|\bonce (?:was )?generated\b|\bformerly\b", re.I)
_BANNER = re.compile(r"^/\*!.*\bv?\d+(?:\.\d+)+")
_CONSTANTS = {"true", "false", "null", "none", "undefined", "nil"}
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|[-+]?\b\d[\w.]*")

FEATURES = ["ratio", "entropy", "ident", "ident_short", "comment", "line_mean", "line_max", "digits", "blank", "literal", "word_share", "size"]


def header(text: str) -> tuple[str, str]:
    """(comment lines at the top, the rest)."""
    at, n = 1 if text[:1] == "﻿" else 0, len(text)
    begin = at
    while at < n:
        end = text.find("\n", at)
        end = n if end < 0 else end + 1
        line = text[at:end].strip()
        if line.startswith("/*"):
            stop = text.find("*/", at + 2)
            stop = n if stop < 0 else stop + 2
            rest = text.find("\n", stop)
            if text[stop : rest if rest >= 0 else n].strip():  # code on the same line
                at = stop
                break
            end = n if rest < 0 else rest + 1
        elif line and not line.startswith(("#", "//", "--", ";;")):
            break
        at = end
    return text[begin:at], text[at:]


def notice(head: str) -> str | None:
    """'written' or 'copied' where a header says so of its own file, sentence by sentence; else None."""
    for line in re.split(r"\n", head):
        if _TAKEN_BACK.search(line):
            continue
        if _WRITTEN.search(line):
            return "written"
        if _COPIED.search(line):
            return "copied"
    return None


def features(body: str) -> list[float]:
    """FEATURES of a text without its header; all zero for an empty one."""
    data = body.encode("utf-8", "replace")
    if not data.strip():
        return [0.0] * len(FEATURES)
    words = re.findall(r"\w+|[^\w\s]", body)
    counts = Counter(words)
    total = max(1, len(words))
    entropy = -sum(c / total * math.log2(c / total) for c in counts.values())
    idents = [w for w in words if w[0].isalpha() or w[0] == "_"]
    lines = body.split("\n")
    comment = sum(1 for x in lines if x.lstrip().startswith(("#", "//", "*", "/*", '"""', "'''")))
    literal = sum(len(m[0]) for m in _LITERAL.finditer(body))
    dense = max(1, sum(map(len, words)))
    return [
        len(zlib.compress(data, 6)) / len(data),
        entropy / max(1.0, math.log2(total)),
        sum(map(len, idents)) / max(1, len(idents)),
        sum(1 for w in idents if len(w) <= 2) / max(1, len(idents)),
        comment / len(lines),
        len(body) / len(lines),
        float(max(map(len, lines))),
        sum(c.isdigit() for c in body) / len(body),
        sum(1 for x in lines if not x.strip()) / len(lines),
        literal / dense,
        sum(map(len, idents)) / dense,
        math.log(len(data)),
    ]


def unquoted(body: str) -> float:
    """Share of word characters outside of literals among all that is no blank; 1 for an empty text."""
    dense = sum(map(len, body.split()))
    words = re.findall(r"\w+", _LITERAL.sub("", body))
    return sum(len(w) for w in words if w.lower() not in _CONSTANTS) / dense if dense else 1.0


def placed(path: Column) -> Column:
    """Whether a path is a place of third-party or tool-written files."""
    parts = F.split(F.lower(F.coalesce(path, F.lit(""))), "[/\\\\]")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.arrays_overlap(folders, F.array(*map(F.lit, PLACES))) | F.coalesce(path, F.lit("")).rlike(SUFFIXES)


def described(files: DataFrame) -> DataFrame:
    """(repo_path, file_path, content_key, said, banner, prose, unquoted, FEATURES...) of every file."""

    def measured(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for repo, path, text in zip(*(batch[c].to_pylist() for c in ("repo_path", "file_path", "content"))):
                text = text or ""
                prose = lexing.language(path, None) == "markdown"
                head, body = ("", text) if prose else header(text)
                tail = body.rstrip().rpartition("\n")[2]
                mapped = bool(re.match(r"//[#@] sourceMappingURL=", tail))
                said = notice(head)
                banner = bool(_BANNER.match(head.lstrip()))
                body = body.rstrip()[: -len(tail)] if mapped else body
                out.append((repo, path, said, banner or mapped, prose, unquoted(body), *features(body)))
            types = [pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.float64(), *[pa.float64()] * len(FEATURES)]
            names = ["repo_path", "file_path", "said", "banner", "prose", "unquoted", *FEATURES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    schema = "repo_path string, file_path string, said string, banner boolean, prose boolean, unquoted double, " + ", ".join(f"{f} double" for f in FEATURES)
    return files.select("repo_path", "file_path", "content").mapInArrow(measured, schema)


def _both_sizes(cases: DataFrame) -> dict[float, int] | None:
    """Rows of each label, if both occur."""
    sizes = {r["label"]: r["count"] for r in cases.groupBy("label").count().collect()}
    return sizes if len(sizes) == 2 else None


def not_handwritten(files: DataFrame, sample: int = 20000, trees: int = 30, least: float = 0.5) -> DataFrame:
    """(repo_path, file_path, reason): files nobody here wrote by hand; reason is place, written, copied or looks.

    ``files`` has repo_path, file_path and content. The forest is fitted on at most about ``sample`` files, taken by a
    hash of their place, and applied to all. As some unlabelled files are not hand-written either, and some labelled ones
    look as if they were, a second forest is fitted without the files whose label a first one contradicts. Null contents count as empty; null paths have no place; files whose key is
    null stay in. Prose (Markdown) is judged by its place only. If no or all sampled files are labelled, or labelled files
    look like the others, looks decide nothing.
    """
    rows = materialize(described(files).withColumn("place", placed(F.col("file_path"))), "features")
    whole = F.col("unquoted") <= 0.05  # one literal makes up the file
    packed = F.coalesce(F.col("file_path"), F.lit("")).rlike(PACKED)
    label = F.coalesce((F.col("said") == "written") | F.col("banner") | packed, F.lit(False)).cast("double")
    n = rows.count()
    share = min(1.0, sample / n) if n else 1.0
    code = rows.filter(~F.col("prose") & (F.col("said").isNull() & ~F.col("place") & ~whole | (label > 0)))
    train = code.withColumn("label", label).filter((F.pmod(F.xxhash64("repo_path", "file_path"), F.lit(1_000_000)) / 1e6) < share)
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    looks = F.lit(False)
    scored = rows
    if _both_sizes(train):
        forest = RandomForestClassifier(numTrees=trees, maxDepth=6, seed=11, weightCol="weight", featureSubsetStrategy="onethird")
        cases = materialize(vector.transform(train).select("label", "features", F.lit(1.0).alias("weight")), "cases")
        first = forest.copy({forest.minInstancesPerNode: 5}).fit(cases)  # no file decides its own look
        like = vector_to_array("probability")[1] >= 0.25  # looks of which a good part is labelled
        kept = materialize(first.transform(cases).filter(like == (F.col("label") > 0)).select("label", "features"), "kept")
        if sizes := _both_sizes(kept):
            weight = F.when(F.col("label") > 0, F.lit(sizes[0.0] / sizes[1.0])).otherwise(1.0)  # both classes weigh the same
            model = forest.fit(kept.withColumn("weight", weight))
            scored = model.transform(vector.transform(rows)).withColumn("p", vector_to_array("probability")[1])
            looks = ~F.col("prose") & (F.col("p") >= least)
    reason = F.when(F.col("place"), "place").when(F.col("said").isNotNull(), F.col("said")).when(looks | (whole & ~F.col("prose")), "looks")
    return scored.select("repo_path", "file_path", reason.alias("reason")).filter("reason is not null")
