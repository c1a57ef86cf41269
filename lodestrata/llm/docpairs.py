"""Functions paired with their documentation, from Python, JavaScript, TypeScript and Go files.

Files are lexed into token rows; everything structural is SQL over those rows. A cumulative sum of brackets gives every
token its depth; the closing bracket of a body is the next one at the depth of its header; runs of comment lines without
a gap are islands; lag and lead attach comments above headers and strings below them. All windows share one exchange by
file, so a file costs one sorted pass, however long it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.llm import lexing

# Words that say nothing about a function, beside those of its own name.
FILLER = frozenset(
    "a an the this that these it its is are be to of for in on and or with by from as at will can does do"
    " function func method helper routine procedure handler implementation class object def"
    " todo fixme xxx tbd tba wip hack document documentation documented docs doc docstring description describe"
    " write add missing placeholder here goes no none nothing yet needed fill me fix later see above below n na".split()
)
# Headings and tags of documentation that are no description by themselves.
HEADINGS = frozenset(
    "args arguments parameters params param returns return yields yield raises raise throws throw exceptions exception"
    " attributes examples example notes note other keyword arg type rtype returned".split()
)

def _stems(word: str) -> set[str]:
    """Forms of a word without its ending; two words are forms of one if they share an element."""
    w = word.lower()
    out = {w}
    for end in ("ies", "ied", "es", "ed", "ing", "er", "ers", "or", "s", "e", "ion", "ation", "ment"):
        if w.endswith(end) and len(w) - len(end) >= 2:
            base = w[: -len(end)]
            out |= {base, base + "y"} if end in ("ies", "ied") else {base}
            if len(base) > 2 and base[-1] == base[-2]:
                out.add(base[:-1])
    return out


def _name_words(name: str) -> list[str]:
    return re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)


def described(name: str, doc: str) -> bool:
    """Whether a documentation text says more than the name, placeholders, markup and bare parameter lists do."""
    text = re.sub(r"(?m)^[ \t]*(?:/\*\*|\*/|///?|\*+)?[ \t]*|\*/[ \t]*$", "", doc)
    kept = []
    lines = [x.strip() for x in text.split("\n")]
    section = None
    for i, line in enumerate(lines):
        if not line:
            continue
        if re.fullmatch(r"[-=~^*_#.\s]+", line):
            continue
        if m := re.match(r"[:@\\](\w+)(.*)", line):
            tag, rest = m[1].lower(), m[2]
            if line[0] == ":":
                rest = rest.partition(":")[2]
            else:
                rest = re.sub(r"^\s*\{[^}]*\}", "", rest)
                if tag in ("param", "arg", "argument", "prop", "property", "template", "typedef"):
                    rest = re.sub(r"^\s*(?:\[[^\]]*\]|[\w.$]+)", "", rest)
            kept.append(re.sub(r"^[\s:-]+", "", rest))
            section = None
            continue
        if m := re.fullmatch(r"(\w+)(?:\s+\w+)?\s*:?", line):
            if m[1].lower() in HEADINGS and (line.endswith(":") or (i + 1 < len(lines) and re.fullmatch(r"[-=~]{3,}", lines[i + 1]))):
                section = m[1].lower()
                continue
        if section in ("args", "arguments", "parameters", "params", "attributes", "other", "keyword"):
            if m := re.fullmatch(r"\*{0,2}[\w.]+(?:\s*\([^)]*\))?\s*(?::\s*(.*))?", line):
                rest = m[1] or ""
                numpy = section in ("parameters", "attributes", "other") and re.fullmatch(r"[\w\[\], .|]*", rest) and len(rest.split()) <= 3
                kept.append("" if numpy else rest)
                continue
        elif section and re.fullmatch(r"[\w.\[\], |]+:?", line) and len(line.split()) == 1:
            continue  # a bare type below Returns and the like
        kept.append(line)
    words = re.findall(r"[^\W\d_]+|\d+", re.sub(r"<[^>\n]{1,40}>|\{@?\w*\s*|`", " ", " ".join(kept)))
    own = set().union(*map(_stems, _name_words(name) or [""]))
    if "".join(_name_words(name)).lower() in {w.lower() for w in words}:
        words = [w for w in words if w.lower() != "".join(_name_words(name)).lower()]
    return any(not (w.lower() in FILLER or _stems(w) & own) for x in words for w in (_name_words(x) or [x]))


TOKENS = "file_id long, lang string, seq int, kind string, text string, line int, first int, begin int, end int"


def tokens(files: DataFrame, file_id: str = "file_id", path: str = "file_path", declared: str = "language", content: str = "content") -> DataFrame:
    """One row per structural token of every file in a known language; see ``lexing.structure``."""

    def lexed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for at in range(0, whole.num_rows, 200):
                rows = whole.slice(at, 200).to_pydict()
                out = []
                for i, p, d, text in zip(rows["file_id"], rows["path"], rows["declared"], rows["content"]):
                    lang = lexing.language(p, d)
                    if lang and lang != "markdown":
                        out += [(i, lang, n, k, t if k in "dfh" else None, a, b, x, y) for n, (k, t, a, b, x, y, _) in enumerate(lexing.structure(text, lang))]
                names = [f.split()[0] for f in TOKENS.split(", ")]
                types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names)

    rows = files.select(files[file_id].cast("long").alias("file_id"), files[path].alias("path"), files[declared].alias("declared"), files[content].alias("content"))
    return rows.filter("file_id is not null and content is not null").mapInArrow(lexed, TOKENS)


@F.pandas_udf(T.BooleanType())
def is_described(name: pd.Series, lang: pd.Series, doc: pd.Series) -> pd.Series:
    texts = [lexing.docstring_text(d) if x == "python" else d for x, d in zip(lang, doc)]
    return pd.Series([described(n, t) for n, t in zip(name, texts)], dtype=bool)


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def documented_functions(toks: DataFrame) -> DataFrame:
    """(file_id, lang, name, line_start, begin, end, doc): functions with a documentation and code in their body."""
    by_file = Window.partitionBy("file_id").orderBy("seq")
    so_far = by_file.rowsBetween(Window.unboundedPreceding, 0)
    rows = toks.withColumns(
        {
            "depth": F.sum(_is("o").cast("int") - _is("c").cast("int")).over(so_far) - _is("o").cast("int"),
            "code": F.sum(_is("x", "f", "h").cast("int")).over(so_far),
            "gap": F.when(_is("d") & (F.lag("kind").over(by_file) == "d") & (F.lag("first").over(by_file) + 1 == F.col("line")), 0).otherwise(1),
            "below": F.when(F.lead("kind").over(by_file) == "o", F.when(F.lead("kind", 2).over(by_file) == "d", F.lead("text", 2).over(by_file))),
        }
    )
    rows = rows.withColumn("island", F.sum("gap").over(so_far))
    island = Window.partitionBy("file_id", "island").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    line_doc = F.when(~F.col("text").rlike(r"^//(?:go:|\s*\+build|\s*nolint)"), F.col("text"))
    rows = rows.withColumn("run", F.when(F.col("lang") == "go", F.concat_ws("\n", F.collect_list(line_doc).over(island))).otherwise(F.col("text")))
    near = (F.lag("kind").over(by_file) == "d") & ((F.lag("first").over(by_file) + 1 == F.col("first")) | (F.lag("first").over(by_file) + 1 == F.col("line")) | (F.lag("first").over(by_file) == F.col("first")))
    rows = rows.withColumn("above", F.when(near, F.lag("run").over(by_file)))
    same_depth = Window.partitionBy("file_id", "depth").orderBy("seq")
    spans = rows.filter(_is("f", "o", "c")).withColumns(
        {
            "opens": F.lead("kind").over(same_depth) == "o",
            "closes": F.lead("kind", 2).over(same_depth) == "c",
            "end_of_body": F.lead("end", 2).over(same_depth),
            "inside": F.lead("code", 2).over(same_depth) - F.lead("code").over(same_depth),
        }
    )
    doc = F.when(F.col("lang") == "python", F.col("below")).otherwise(F.col("above"))
    found = spans.filter(_is("f") & F.col("opens") & F.col("closes") & (F.col("inside") > 0))
    return found.select("file_id", "lang", F.col("text").alias("name"), F.col("line").alias("line_start"), "begin", F.col("end_of_body").alias("end"), doc.alias("doc")).filter("doc is not null")


def docstring_pairs(files: DataFrame) -> DataFrame:
    """(file_id, name, line_start, docstring, code) of every function whose documentation says something.

    ``files`` has file_id, file_path, language and content. Null contents, unknown languages and empty files give no
    rows; a null language is taken from the extension; unfinished functions at the end of a broken file are left out.
    """
    found = documented_functions(tokens(files)).filter(is_described("name", "lang", "doc"))
    text = files.select("file_id", "content")
    code = F.substring(F.col("content"), F.col("begin") + 1, F.col("end") - F.col("begin"))
    return found.join(text, "file_id").select("file_id", "name", "line_start", F.col("doc").alias("docstring"), code.alias("code"))


def found(files: DataFrame) -> DataFrame:
    """(file_id, name, line_start) of the functions that ``docstring_pairs`` gives."""
    return documented_functions(tokens(files)).filter(is_described("name", "lang", "doc")).select("file_id", "name", "line_start")
