"""Splitting oversized items at natural boundaries, by ranges.

An item is cut into ranges of RANGE characters (of a file: bytes) with a halo on both sides, which are spread over all tasks;
of a file each task reads only its ranges, so that no file is ever loaded whole. A worker moves both ends of its range to the
next line start, scans it once for every lexical state in which it may begin, and reports for each the state and bracket depth
at its end, the lines in it and the lines where units begin. Stitching picks the true state of each range: the reports of BLOCK
ranges are composed to one, the blocks of an item are followed in order, and prefix sums turn relative lines, depths and
offsets into absolute ones. Pieces are then emitted block by block, a new piece beginning with each block of a giant item. No
task holds more than a block's boundaries and line lengths, or one small row for each block of an item.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm import lexing
from lodestrata.storage import materialize

RANGE, HALO = 1 << 16, 4096
#: Ranges that are stitched together by one task; with RANGE the most text between two forced cuts.
BLOCK = 64

_PY_UNIT = re.compile(r"(?:(?:async[ \t]+)?def|class)[ \t]+\w+")
_GO_UNIT = re.compile(r"func\b|type\b[ \t]*(?:\w|\()")
_JS_UNIT = re.compile(
    r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?(?:abstract[ \t]+)?(?:(?:async[ \t]+)?function\b[ \t]*\*?[ \t]*\w*[ \t]*[(<]|class\b)"
    r"|(?:export[ \t]+)?const[ \t]+[\w$]+[ \t]*(?::[^=\n]*(?:=>[^=\n]*)?)?=[ \t]*(?:async\b[ \t]*)?(?:<[^>\n]*>[ \t]*)?(?:[\w$]+[ \t]*=>|\((?P<args>))"
)
_HEADING = re.compile(r"[ ]{0,3}#{1,6}(?:[ \t]+\S|[ \t]*\r?$)")
_FENCE = re.compile(r"[ ]{0,3}(`{3,}|~{3,})")
STATES = {"python": ["code", '"""', "'''"], "javascript": ["code", "block", "tick"], "typescript": ["code", "block", "tick"], "go": ["code", "block", "tick"]}


def _states(lang: str | None) -> list[str]:
    return ["code", "```", "~~~"] if lang == "markdown" else STATES.get(lang or "", ["code"])


def scan(text: str, begin: int, end: int, lang: str | None, state: str) -> tuple[str, int, list[tuple[int, int]]]:
    """(state at ``end``, change of depth, units) of ``text[begin:end]`` if it starts in ``state``.

    A unit is (line, depth): the 0-based line from ``begin`` on where it starts, with decorators and comment lines
    directly above it (these may lie in the halo before ``begin``, as negative lines), and its depth relative to it.
    """
    if lang == "markdown":
        return _scan_markdown(text, begin, end, state)
    if lang not in STATES:
        return "code", 0, []
    return _scan_code(text, begin, end, lang, state)


def _scan_markdown(text: str, begin: int, end: int, state: str) -> tuple[str, int, list[tuple[int, int]]]:
    fence = "" if state == "code" else state
    units = []
    for n, line in enumerate(text[begin:end].split("\n")):
        m = _FENCE.match(line)
        if fence:
            if m and m[1].startswith(fence) and not line.strip().strip(fence[0]):
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in line[m.end() :]):
            fence = m[1]
        elif _HEADING.match(line):
            units.append((n, 0))
    return fence[:3] or "code", 0, units


def _masked(text: str, lang: str, state: str) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int, int]], str]:
    """(is code: one flag a character, comments, brackets (offset, change, depth after), state at the end)."""
    code = np.ones(len(text) + 1, bool)
    comments, brackets, depth, last = [], [], 0, "code"
    if lang == "python":
        at, n = 0, len(text)
        if state != "code":
            m = lexing._PY_END[state].match(text)
            at = m.end() if m else n
            code[:at] = False
            last = "code" if m else state
        while at < n:
            m = lexing._PY.search(text, at)
            if not m:
                break
            kind, b, at = m.lastgroup, m.start(), m.end()
            if kind == "str":
                e = lexing._PY_END[m[0][-3:]].match(text, at)
                at, last = (e.end(), "code") if e else (n, m[0][-3:])
            if kind in ("str", "short", "com"):
                code[b:at] = False
                if kind == "com":
                    comments.append((b, at))
            elif kind == "nl" and depth and lexing._PY_RESET.match(text, at):
                brackets.append((b, -depth, 0))
                depth = 0
            elif kind in ("open", "close"):
                change = 1 if kind == "open" else -1 if depth else 0
                depth += change
                brackets.append((b, change, depth))
        return code, comments, brackets, last
    for kind, b, e in lexing._significant(text, state):
        if kind in ("line", "block", "short", "tick") or (kind == "slash" and e - b > 1):
            code[b:e] = False
            if kind in ("line", "block"):
                comments.append((b, e))
            if e == len(text) and (kind == "block" and not text.endswith("*/") or kind == "tick" and not text.endswith("`")):
                last = kind
        elif kind in ("open", "close"):
            depth += 1 if kind == "open" else -1
            brackets.append((b, 1 if kind == "open" else -1, depth))
    return code, comments, brackets, last


def _scan_code(text: str, begin: int, end: int, lang: str, state: str) -> tuple[str, int, list[tuple[int, int]]]:
    body = text[begin:end]
    code, comments, brackets, last = _masked(body, lang, state)
    starts = [0] + [m.end() for m in re.finditer("\n", body)]
    at = np.array([b for b, _, _ in brackets], np.int64)
    after = [d for _, _, d in brackets]
    # Lines that hold only a comment, or a part of one.
    only = set()
    for b, e in comments:
        first, final = np.searchsorted(starts, b, "right") - 1, np.searchsorted(starts, max(b, e - 1), "right") - 1
        if not body[starts[first] : b].strip("﻿ \t\r") and not body[e : starts[final + 1] if final + 1 < len(starts) else len(body)].strip():
            only.update(range(int(first), int(final) + 1))
    halo = text[:begin].split("\n")[:-1][::-1] if begin else []  # whole lines above, nearest first

    def depth_at(offset: int) -> int:
        i = int(np.searchsorted(at, offset, "left"))
        return after[i - 1] if i else 0

    def above(n: int) -> int:
        """First of the decorator and comment lines directly above line n."""
        while n > 0 and (n - 1 in only or decorator(n - 1)):
            n -= 1
        if n == 0:
            mark = {"python": r"[#@]"}.get(lang, r"//|@|/\*|\*")
            for line in halo:
                if not re.match(mark, line.lstrip()):
                    break
                n -= 1
        return n

    decorators: dict[int, int] = {}
    for n, s in enumerate(starts):
        if body.startswith("@", s) and code[s]:  # a decorator may have arguments on several lines
            stop = body.find("\n", s)
            stop = len(body) if stop < 0 else stop
            while stop < len(body) and depth_at(stop) > depth_at(s):
                nxt = body.find("\n", stop + 1)
                stop = len(body) if nxt < 0 else nxt
            for k in range(n, int(np.searchsorted(starts, stop, "left"))):
                decorators[k] = n

    def decorator(n: int) -> bool:
        return n in decorators

    pattern = {"python": _PY_UNIT, "go": _GO_UNIT}.get(lang, _JS_UNIT)
    rest = text[begin:]  # a parameter list may go beyond the range
    whole = code if len(rest) == len(body) or pattern is not _JS_UNIT else _masked(rest, lang, state)[0]
    units = []
    for n, s in enumerate(starts):
        if n == 0 and body.startswith("﻿"):
            s += 1
        m = pattern.match(body, s)
        if m and s < len(body) and code[s]:
            if m.groupdict().get("args") is not None and not _is_arrow(rest, whole, m.end()):
                continue
            units.append((above(n), 0 if lang == "python" else depth_at(s)))  # in Python the column alone tells
    return last, after[-1] if after and lang != "python" else 0, units


def _is_arrow(text: str, code: np.ndarray, at: int) -> bool:
    """Whether the bracket that opens just before ``at`` is an arrow function's parameter list. ``code`` masks strings and comments."""
    depth, typed = 1, False
    for i in range(at, len(text)):
        c = text[i]
        if c.isspace() or not code[i]:
            continue
        if not depth:
            if text.startswith("=>", i):
                return True
            if not typed and c != ":" or c in ";=)]}":
                return False
            typed = True
        depth += (c in "([{") - (c in ")]}")
    return False


def _line_start(text: str, at: int) -> int:
    """After the first blank line at or after ``at`` within a halo, else the first line start there, else ``at`` itself."""
    if not at:
        return 0
    blank = re.compile(r"\n[ \t]*\r?\n").search(text, at - 1, at + HALO)
    i = blank.end() - 1 if blank else text.find("\n", at - 1, at + HALO)
    return i + 1 if i >= 0 else at


SLICES = "item long, path string, declared string, part int, head int, stop int, last boolean, slice string"
SCANS = "item long, block int, part int, state string, last string, change int, lines int, size long, chars array<int>, unit_line array<int>, unit_depth array<int>"
STARTS = "item long, block int, state string, depth int, line long, offset long"


def _batches(rows: Iterator[tuple], schema: str, size: int = 128) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of at most ``size`` rows."""
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    while some := list(islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*some), fields)], [n for n, _ in fields])


def _rows(it: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in it:
        yield from batch.to_pylist()


def slices(items: DataFrame, limit: int, size: int = RANGE) -> DataFrame:
    """The ranges, with halos, of every item (item, path, declared, content) longer than ``limit``, spread over all tasks."""

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for r in _rows(it):
                text = r["content"]
                for part, at in enumerate(range(0, len(text), size)):
                    low = max(0, at - HALO)
                    piece = text[low : at + size + HALO]
                    yield r["item"], r["path"], r["declared"], part, at - low, min(at - low + size, len(piece)), at + size >= len(text), piece

        return _batches(rows(), SLICES)

    long = items.filter("item is not null and content is not null").filter(F.char_length("content") > limit)
    return _spread(long.select(F.col("item").cast("long").alias("item"), "path", "declared", "content").mapInArrow(cut, SLICES))


def file_slices(files: DataFrame, limit: int, size: int = RANGE) -> DataFrame:
    """The same of files (item, uri, path, declared, bytes) of more than ``limit`` bytes; each range is read by itself.

    ``uri`` is one that all executors can open (file, hdfs, s3, gs). Bytes that are no UTF-8 become replacement characters.
    """

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def start(data: bytes, at: int) -> int:
            while at < len(data) and data[at] & 0xC0 == 0x80:  # within a character
                at += 1
            return at

        def rows() -> Iterator[tuple]:
            for r in _rows(it):
                system, path = fs.FileSystem.from_uri(r["uri"])
                at, end = r["part"] * size, min((r["part"] + 1) * size, r["bytes"])
                low = max(0, at - HALO)
                with system.open_input_file(path) as f:
                    data = f.read_at(min(end + HALO, r["bytes"]) - low, low)
                cuts = start(data, 0), start(data, at - low), start(data, end - low)
                head, own, tail = (data[x:y].decode("utf-8", "replace") for x, y in zip(cuts, (*cuts[1:], len(data))))
                yield r["item"], r["path"], r["declared"], r["part"], len(head), len(head) + len(own), end >= r["bytes"], head + own + tail

        return _batches(rows(), SLICES)

    parts = F.explode(F.sequence(F.lit(0), ((F.col("bytes") - 1) / size).cast("int"))).alias("part")
    listed = files.filter(F.col("bytes") > limit).select("item", "uri", "path", "declared", F.col("bytes").cast("long").alias("bytes"), parts)
    return _spread(listed).mapInArrow(read, SLICES)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows evenly over as many tasks as a shuffle has; their number is given, so that few large rows are not put together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "item", "part")


def scans(cut: DataFrame) -> DataFrame:
    """One row per range and start state."""

    def scanned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for r in _rows(it):
                lang, text = lexing.language(r["path"], r["declared"]), r["slice"]
                begin = _line_start(text, r["head"])
                end = max(begin, len(text) if r["last"] else _line_start(text, r["stop"]))
                lines = text[begin:end].split("\n")
                chars = [len(x) + 1 for x in lines]
                chars[-1] -= 1
                for state in _states(lang) if r["part"] else ["code"]:
                    last, change, units = scan(text, begin, end, lang, state)
                    at = r["item"], r["part"] // BLOCK, r["part"], state
                    yield *at, last, change, len(lines) - 1, end - begin, chars if state == "code" else None, [u[0] for u in units], [u[1] for u in units]

        return _batches(rows(), SCANS)

    return materialize(cut.mapInArrow(scanned, SCANS), "scans")


def _by_block(rows: DataFrame, f: Callable[[tuple, list[dict]], Iterator[tuple]], schema: str, *keys: str) -> DataFrame:
    """``f`` of the rows of each combination of ``keys``, in order of all their columns but arrays."""

    def grouped(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = groupby(_rows(it), key=lambda r: tuple(r[k] for k in keys))
        return _batches((row for key, own in groups for row in f(key, list(own))), schema, 4096)

    order = [c for c in ("item", "block", "of", "part", "state") if c in rows.columns]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys, *(c for c in order if c not in keys)).mapInArrow(grouped, schema)


def _follow(parts: list[dict], state: str, depth: int) -> Iterator[tuple[dict, int]]:
    """(the true report, depth at its start) of consecutive ranges."""
    by: dict[int, dict[str, dict]] = {}
    for r in parts:
        by.setdefault(r["part"], {})[r["state"]] = r
    for p in sorted(by):
        own = by[p].get(state) or by[p]["code"]
        yield own, depth
        state, depth = own["last"], max(0, depth + own["change"])


def block_starts(reports: DataFrame) -> DataFrame:
    """(item, block, state, depth, line, offset) at the start of every block but the first."""
    light = reports.drop("chars", "unit_line", "unit_depth")
    giant = light.join(light.filter("block > 0").select("item").distinct(), "item", "left_semi")

    def composed(key: tuple, parts: list[dict]) -> Iterator[tuple]:
        for state in sorted({r["state"] for r in parts if r["part"] == parts[0]["part"]}):
            last, change, least, lines, size = state, 0, 0, 0, 0  # depth becomes max(least, depth + change)
            for own, _ in _follow(parts, state, 0):
                last, change, least = own["last"], change + own["change"], max(0, least + own["change"])
                lines, size = lines + own["lines"], size + own["size"]
            yield *key, state, last, change, least, lines, size

    whole = "item long, block int, state string, last string, change int, least int, lines long, size long"
    blocks = _by_block(giant, composed, whole, "item", "block")

    def followed(key: tuple, blocks: list[dict]) -> Iterator[tuple]:
        by: dict[int, dict[str, dict]] = {}
        for r in blocks:
            by.setdefault(r["block"], {})[r["state"]] = r
        state, depth, line, offset = "code", 0, 0, 0
        for b in sorted(by):
            if b:
                yield *key, b, state, depth, line, offset
            own = by[b].get(state) or by[b]["code"]
            state, depth = own["last"], max(own["least"], depth + own["change"])
            line, offset = line + own["lines"], offset + own["size"]

    return _by_block(blocks, followed, STARTS, "item")


def _placed(reports: DataFrame) -> DataFrame:
    """Reports with what holds at the start of their block (columns state0, depth0, line0, offset0; null in the first)."""
    starts = block_starts(reports)
    names = {c: f"{c}0" for c in ("state", "depth", "line", "offset")}
    return reports.join(starts.withColumnsRenamed(names), ["item", "block"], "left")


def _block_units(own: list[dict]) -> list[int]:
    """Lines, within a block, where units begin; negative ones belong to the block before."""
    line, out = 0, []
    for r, depth in _follow(own, own[0]["state0"] or "code", own[0]["depth0"] or 0):
        out += [line + u for u, d in zip(r["unit_line"], r["unit_depth"]) if depth + d == 0]
        line += r["lines"]
    return sorted(set(out))


def _line_lengths(parts: list[dict]) -> list[int]:
    """Characters of every line of consecutive ranges, with its newline; the last line may go on."""
    chars = [0]
    for r in parts:
        if r["chars"] is not None:
            chars[-1] += r["chars"][0]
            chars += r["chars"][1:]
    return chars


def pieces(chars: np.ndarray, units: np.ndarray, blank: np.ndarray, limit: int, overlap: int, fresh: int = 0) -> list[tuple[int, int, int, int]]:
    """(begin offset, end offset, first line, last line), 0-based, of pieces of at most ``limit`` characters.

    A piece ends before the last unit that fits, else after the last blank line, else after the last line that fits; a
    line longer than the limit is cut within. The next piece repeats ``overlap`` lines, fewer where else it could not grow.
    The lines before ``fresh`` are only there to be repeated.
    """
    ends = np.cumsum(chars)
    starts = ends - chars
    n, out, first = len(chars), [], max(0, fresh - overlap)
    while fresh < n:
        if chars[fresh] > limit:
            for at in range(int(starts[fresh]), int(ends[fresh]), limit):
                out.append((at, min(at + limit, int(ends[fresh])), fresh, fresh))
            fresh += 1
            first = fresh
            continue
        while first < fresh and ends[fresh] - starts[first] > limit:
            first += 1
        stop = int(np.searchsorted(ends, starts[first] + limit, "right"))  # lines first..stop-1 fit
        if stop < n:
            cut = units[(units > fresh) & (units <= stop)]
            if not len(cut):
                cut = blank[(blank >= fresh) & (blank < stop)] + 1
            stop = int(cut[-1]) if len(cut) else stop
        out.append((int(starts[first]), int(ends[stop - 1]), first, stop - 1))
        fresh, first = stop, max(0, stop - overlap)
    return out


def cut_lines_of(cut: DataFrame) -> DataFrame:
    """(item, line) of ranges as ``slices`` and ``file_slices`` give them; see ``cut_lines``."""
    reports = scans(cut)

    def units(key: tuple, own: list[dict]) -> Iterator[tuple]:
        first = own[0]["line0"] or 0
        return ((key[0], first + u) for u in _block_units(own) if first + u > 0)

    lines = _by_block(_placed(reports), units, "item long, line long", "item", "block").distinct()
    none = reports.filter("part = 0").select("item").distinct().withColumn("line", F.lit(-1).cast("long"))
    least = lines.unionByName(none).groupBy("item").agg(F.max("line").alias("most"))
    return lines.unionByName(least.filter("most < 0").select("item", F.col("most").alias("line")))


def cut_lines(items: DataFrame, limit: int = 6000, size: int = RANGE) -> DataFrame:
    """(item, line): 0-based lines other than the first at which units begin in items over ``limit``; -1 where none does.

    ``items``: item, path, declared, content. Null contents, ids and short items give no rows. Unknown languages have none.
    Items of the same id count as one; ids should be unique.
    """
    return cut_lines_of(slices(items, limit, size))


def split_of(cut: DataFrame, limit: int = 6000, overlap: int = 10) -> DataFrame:
    """(item, piece, begin, end, first_line, last_line) of ranges as ``slices`` and ``file_slices`` give them; see ``split``."""
    reports = _placed(scans(cut))
    # A block sees the last range of the one before, whose last lines its first piece repeats.
    before = (F.col("part") % BLOCK == BLOCK - 1) & F.col("chars").isNotNull()
    shared = reports.withColumn("of", F.explode(F.when(before, F.array(F.col("block"), F.col("block") + 1)).otherwise(F.array("block"))))

    def emitted(key: tuple, rows: list[dict]) -> Iterator[tuple]:
        own = [r for r in rows if r["block"] == key[1]]
        if not own:
            return
        context = _line_lengths([r for r in rows if r["block"] != key[1]])
        chars = _line_lengths(own)
        fresh = 0
        if len(context) > 1 and context[-1] == 0:  # the block begins a line
            context = context[:-1][-overlap:] if overlap else []
            fresh, chars = len(context), context + chars
        if len(chars) > 1 and chars[-1] == 0:
            chars = chars[:-1]  # nothing comes after the last newline here
        units = np.array([fresh + u for u in _block_units(own) if u >= 0], np.int64)
        line0, offset0 = own[0]["line0"] or 0, own[0]["offset0"] or 0
        at = offset0 - sum(chars[:fresh])
        lengths = np.array(chars, np.int64)
        for begin, end, first, last in pieces(lengths, units, np.flatnonzero(lengths <= 1), limit, overlap, fresh):
            yield key[0], key[1], at + begin, at + end, line0 - fresh + first, line0 - fresh + last

    found = _by_block(shared, emitted, "item long, block int, begin long, end long, first_line long, last_line long", "item", "of")
    found = materialize(found, "pieces")
    # Pieces are numbered by their place in the block and the pieces of the blocks before.
    sizes = found.groupBy("item", "block").count()
    earlier = F.coalesce(F.sum("count").over(Window.partitionBy("item").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("item", "block").orderBy("end"))
    rows = found.withColumn("place", within).join(sizes.select("item", "block", earlier.alias("earlier")), ["item", "block"])
    return rows.select("item", (F.col("earlier") + F.col("place") - 1).cast("int").alias("piece"), "begin", "end", "first_line", "last_line")


def split(items: DataFrame, limit: int = 6000, overlap: int = 10, size: int = RANGE) -> DataFrame:
    """(item, piece, begin, end, first_line, last_line): the pieces of items over ``limit`` by offset; lines 0-based."""
    return split_of(slices(items, limit, size), limit, overlap)
