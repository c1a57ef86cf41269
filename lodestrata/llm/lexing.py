"""Lexers for Python, JavaScript, TypeScript, Go and Markdown, which need no valid file.

``structure`` gives the tokens that matter for functions and units: headers, brackets, documentation and code lines.
``units`` gives the lines at which top-level units begin, for a given state at the start of the text, so that ranges of a
file can be scanned separately. Bad input never fails: an open string or bracket ends where the next top-level header
shows that it was not meant to go on.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

# Languages by file extension.
LANGUAGES = {
    "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "go": "go", "md": "markdown", "markdown": "markdown",
}

_PY = re.compile(
    r"(?P<com>#[^\n]*)"
    r"|(?P<str>[rbufRBUF]{0,3}(?:\"\"\"|'''))"
    r"|(?P<short>[rbufRBUF]{0,3}(?:\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z)))"
    r"|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<nl>\n)|(?P<join>\\\r?\n)|(?P<word>\w+|[^\w\s\"'#()\[\]{}\\]+|\\)"
)
_PY_END = {q: re.compile(r"(?:[^\\" + q[0] + r"]|\\[\s\S]|" + q[0] + r"(?!" + q[1:] + r"))*" + q) for q in ('"""', "'''")}
_PY_HEAD = re.compile(r"(?:async[ \t]+)?def[ \t]+(\w+)|class[ \t]+(\w+)|(@)[\w.]")
_PY_RESET = re.compile(r"[ \t]*(?:(?:async[ \t]+)?def[ \t]+\w+[ \t]*\(|class[ \t]+\w+[ \t]*[:(]|@\w[\w.]*[ \t]*(?:\(|\r?\n))")

# After these a slash starts a regular expression, not a division.
_BEFORE_REGEX = set("(,=:[!&|?{};+-*%~^<>\n")
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_C = re.compile(
    r"(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<short>\"(?:[^\"\\\n]|\\[\s\S])*(?:\"|(?=\n)|\Z)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|\Z))"
    r"|(?P<tick>`)|(?P<open>[{(\[])|(?P<close>[})\]])|(?P<nl>\n)|(?P<word>[\w$]+)|(?P<slash>/)|(?P<other>[^\w\s$\"'`(){}\[\]/]+?(?=\s|[\w$\"'`(){}\[\]/]|\Z))"
)
_TICK = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")

Token = tuple[str, str, int, int, int, int, bool]  # kind, name or text, line, end line, offset, end offset, flag


def language(path: str | None, declared: str | None) -> str | None:
    """By file extension, else as declared; None for any other language."""
    ext = (path or "").rpartition(".")[2].lower()
    named = (declared or "").strip().lower()
    return LANGUAGES.get(ext) or (named if named in LANGUAGES.values() else None)


def structure(text: str, lang: str) -> list[Token]:
    """Tokens in order. Kinds:

    f function header (name; its second line number is that of its decorators or modifiers), h class header, o and c
    brackets of blocks (for Python of indented bodies), d documentation (comment or string statement; its text), x the
    first code of a line. Line numbers are 1-based; the offset of a header is where its decorators or modifiers begin.
    """
    if lang == "python":
        return _python(text)
    return _braces(text, lang) if lang in ("javascript", "typescript", "go") else []


def _python(text: str) -> list[Token]:
    out: list[Token] = []
    levels, depth, at, line, start_of_line = [0], 0, 0, 1, 0
    first: tuple[int, int, int] | None = None  # line, offset, column of the logical line's first token
    strings: list[tuple[int, int]] = []
    only_strings, decorated = True, None
    n = len(text)
    if text[:1] == "﻿":
        at = start_of_line = 1

    def finish(end: int) -> None:
        nonlocal first, only_strings, strings, decorated
        if first is None:
            return
        row, begin, column = first
        while len(levels) > 1 and column < levels[-1]:
            levels.pop()
            out.append(("c", "", row, row, begin, begin, False))
        if column > levels[-1]:
            levels.append(column)
            out.append(("o", "", row, row, begin, begin, False))
        head = _PY_HEAD.match(text, begin)
        if head and head[3]:
            decorated = decorated or (begin, row)
            out.append(("x", "@", row, line, begin, end, False))
        elif head and head[1]:
            out.append(("f", head[1], row, (decorated or (begin, row))[1], (decorated or (begin, row))[0], end, True))
            if text[begin:end].rstrip().rpartition("#")[0 if "#" in text[begin:end] else 2].rstrip()[-1:] not in (":", ""):
                out.append(("x", "inline", row, line, begin, end, False))
            decorated = None
        elif head and head[2]:
            out.append(("h", head[2], row, line, (decorated or (begin, row))[0], end, True))
            decorated = None
        elif only_strings and strings and not text[strings[-1][1] : end].strip(" \t\r;"):
            out.append(("d", text[strings[0][0] : strings[-1][1]], row, line, begin, end, False))
            decorated = None
        else:
            out.append(("x", "", row, line, begin, end, False))
            decorated = None
        first, only_strings, strings = None, True, []

    while at < n:
        m = _PY.search(text, at)
        if not m:
            break
        kind, begin = m.lastgroup, m.start()
        at = m.end()
        if kind == "nl":
            line += 1
            start_of_line = at
            if depth and _PY_RESET.match(text, at):
                depth = 0
            if not depth:
                line -= 1
                finish(begin)
                line += 1
            continue
        if kind == "com":
            continue
        if kind == "join":
            line += 1
            continue
        if first is None:
            column = len(text[start_of_line:begin].expandtabs(8))
            first = (line, begin, column)
        if kind == "str":
            end = _PY_END[m[0][-3:]].match(text, at)
            at = end.end() if end else n
            line += text.count("\n", begin, at)
            strings.append((begin, at))
        elif kind == "short":
            line += text.count("\n", begin, at)
            strings.append((begin, at))
        else:
            only_strings = False
            depth += (kind == "open") - (kind == "close" and depth > 0)
    finish(n)
    out.extend(("c", "", line, line, n, n, False) for _ in levels[1:])
    return out


def docstring_text(literal: str) -> str:
    """The text within the quotes of one or more adjacent Python string literals."""
    parts = re.findall(r"[rbufRBUF]{0,3}(\"\"\"|'''|\"|')([\s\S]*?)(?:\1|\Z)", literal)
    return "".join(p[1] for p in parts)


_NOT_METHODS = frozenset("if for while switch catch with return function await typeof new super throw else do delete void yield in of case".split())
_MODIFIERS = frozenset("export default async static public private protected readonly override abstract declare get set accessor".split())


def _significant(text: str, state: str = "code") -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end) of all but white space; kinds as in the pattern, with blocks, templates and regexes whole."""
    at, n, before = 0, len(text), "\n"
    if text[:1] == "﻿":
        at = 1
    if state in ("block", "tick"):
        end = text.find("*/" if state == "block" else "`")
        at = n if end < 0 else end + (2 if state == "block" else 1)
        yield state, 0, at
        before = '"'
    while at < n:
        m = _C.search(text, at)
        if not m:
            return
        kind, begin, at = m.lastgroup, m.start(), m.end()
        if kind == "block":
            end = text.find("*/", at)
            at = n if end < 0 else end + 2
        elif kind == "tick":
            at = _template(text, at)
            before = "`"
        elif kind == "slash":
            r = _REGEX.match(text, begin) if before in _BEFORE_REGEX else None
            at = r.end() if r else at
            before = "/" if not r else "`"
        elif kind not in ("line",):
            word = m[0]
            before = "(" if kind == "word" and word in ("return", "typeof", "case", "in", "of", "delete", "void", "throw") else word[-1]
        yield kind, begin, at


def _template(text: str, at: int) -> int:
    """The end of a template literal (or Go raw string) whose first character is at ``at``."""
    n = len(text)
    while at < n:
        at = _TICK.match(text, at).end()
        if text.startswith("${", at):
            depth, at = 1, at + 2
            while at < n and depth:
                c = text[at]
                depth += (c == "{") - (c == "}")
                at = _template(text, at + 1) if c == "`" else at + 1
        else:
            return min(n, at + 1)
    return n


def _braces(text: str, lang: str) -> list[Token]:
    toks = [(k, b, e) for k, b, e in _significant(text) if k != "nl"]
    newlines = [m.start() for m in re.finditer("\n", text)]
    out: list[Token] = []
    go, last_line = lang == "go", 0
    context: list[str] = []  # what each open bracket belongs to
    pending = ""  # what the next { opens
    n = len(toks)

    def word(i: int) -> str:
        return text[toks[i][1] : toks[i][2]] if 0 <= i < n else ""

    def after_parens(i: int) -> int:
        """Index after the bracket group that opens at i."""
        depth = 0
        while i < n:
            depth += (toks[i][0] == "open") - (toks[i][0] == "close")
            i += 1
            if not depth:
                return i
        return n

    def fresh(i: int) -> bool:
        """Whether a statement may begin at token i."""
        return i == 0 or word(i - 1) in ("}", "{", ";") or "\n" in text[toks[i - 1][2] : toks[i][1]] or toks[i - 1][0] in ("line", "block")

    def header(name: str, line: int, begin: int, end: int) -> None:
        out.append(("f", name, line, bisect_left(newlines, begin) + 1, begin, end, True))

    i = 0
    start = None
    while i < n:
        kind, begin, end = toks[i]
        line = bisect_left(newlines, begin) + 1
        if kind in ("line", "block"):
            doc = text.startswith("/**", begin) and end - begin > 4 if not go else kind == "line"
            own = not text[text.rfind("\n", 0, begin) + 1 : begin].strip("﻿ \t\r")
            if doc and (own or not go):
                out.append(("d", text[begin:end], line, bisect_left(newlines, end - 1) + 1, begin, end, own))
            i += 1
            continue
        w = text[begin:end]
        top, in_class = not context, bool(context) and context[-1] == "class"
        if (top or in_class) and fresh(i) and start is None and w not in ("}",):
            start = begin
            if w == "@" or w.startswith("@"):  # a decorator: the header begins here
                i += 2
                while word(i) == "." or (i < n and toks[i][0] == "word" and word(i - 1) == "."):
                    i += 1
                i = after_parens(i) if word(i) == "(" else i
                continue
        name = None
        if go:
            if w == "func" and top and fresh(i):
                j = after_parens(i + 1) if word(i + 1) == "(" else i + 1
                if j < n and toks[j][0] == "word":
                    name, pending = word(j), "body"
        elif w == "function" and i + 1 < n:
            j = i + 2 if word(i + 1) == "*" else i + 1
            if toks[min(j, n - 1)][0] == "word" and word(j + 1)[:1] in ("(", "<"):
                name, pending = word(j), "body"
        elif w == "class" and word(i - 1) != "." and i + 1 < n and toks[i + 1][0] == "word":
            out.append(("h", word(i + 1), line, line, start if start is not None else begin, end, top))
            pending = "class"
        elif w == "const" and top and i + 1 < n and toks[i + 1][0] == "word":
            arrow = _arrow(toks, text, i + 2, after_parens)
            if arrow:
                name = word(i + 1)
                body = arrow
                header(name, line, start if start is not None else begin, end)
                if word(body) != "{":  # an expression: its own block up to the end of the statement
                    stop = _expression_end(toks, text, body, after_parens)
                    a, b = toks[body][1] if body < n else len(text), toks[stop - 1][2]
                    out.append(("o", "", line, line, a, a, False))
                    out.append(("x", "", bisect_left(newlines, a) + 1, line, a, b, False))
                    out.append(("c", "", bisect_left(newlines, b - 1) + 1, line, b, b, False))
                    i, start = stop, None
                    continue
                i, pending, start = body, "body", None
                continue
        elif in_class and kind == "word" and w not in _MODIFIERS | _NOT_METHODS and word(i + 1)[:1] in ("(", "<") and word(i - 1) not in (".", "=", "=>", "new"):
            j = i + 1
            if word(j).startswith("<"):
                while j < n and not word(j).startswith("("):
                    j += 1
            j = after_parens(j)
            if word(j) == ":":
                while j < n and word(j) not in ("{", ";") and not (fresh(j) and word(j - 1) not in (":", "|", "&", "<", ",")):
                    j = after_parens(j) if toks[j][0] == "open" else j + 1
            if word(j) == "{":
                header(w, line, start if start is not None else begin, end)
                i, pending, start = j, "body", None
                continue
        if name:
            header(name, line, start if start is not None and top else begin, end)
            j = i + 1
            while j < n and word(j) != "{" and not (word(j) == ";" or (go and "\n" in text[toks[j - 1][2] : toks[j][1]] and toks[j - 1][0] != "open")):
                j = after_parens(j) if toks[j][0] == "open" and word(j) != "{" else j + 1
            start = None
            if word(j) != "{":
                pending = ""
            i = j
            continue
        if kind == "open":
            context.append(pending if w == "{" and pending else w)
            if w == "{":
                pending = ""
                start = None
                out.append(("o", "", line, line, begin, end, context[-1] == "class"))
            i += 1
            continue
        if kind == "close":
            while context and w == "}" and context[-1] in ("(", "["):
                context.pop()  # a bracket that was never closed
            if context:
                context.pop()
                if w == "}":
                    start = None
                    out.append(("c", "", line, line, begin, end, False))
            i += 1
            continue
        if line != last_line and not (start is not None and w in _MODIFIERS):
            out.append(("x", "", line, line, begin, end, False))
            last_line = line
        if w.endswith(";"):
            start = None
        elif start is not None and fresh(i) and begin != start and w not in _MODIFIERS and word(i - 1) not in _MODIFIERS:
            start = begin
        i += 1
    return out


def _arrow(toks: list, text: str, i: int, after_parens) -> int | None:
    """Index of the body of an arrow function assigned at token i (after the name), else None."""
    n = len(toks)

    def word(k: int) -> str:
        return text[toks[k][1] : toks[k][2]] if k < n else ""

    if word(i).startswith(":"):  # a type: up to the assignment
        while i < n and word(i) != "=" and word(i) != ";":
            i = after_parens(i) if toks[i][0] == "open" else i + 1
    if word(i) != "=":
        return None
    i += 1
    if word(i) == "async":
        i += 1
    if word(i).startswith("<"):
        while i < n and word(i) != "(":
            i += 1
    if word(i) == "(":
        i = after_parens(i)
        if word(i).startswith(":"):
            while i < n and word(i) != "=>" and word(i) != ";":
                i = after_parens(i) if toks[i][0] == "open" else i + 1
    elif i < n and toks[i][0] == "word":
        i += 1
    return i + 1 if word(i) == "=>" else None


def _expression_end(toks: list, text: str, i: int, after_parens) -> int:
    """Index after the expression that begins at token i."""
    n, begin = len(toks), i
    while i < n:
        w = text[toks[i][1] : toks[i][2]]
        if w.startswith(";") or toks[i][0] == "close":
            return max(i, begin + 1)
        if i > begin and toks[i][0] == "word" and "\n" in text[toks[i - 1][2] : toks[i][1]] and toks[i - 1][0] in ("word", "close", "short", "tick"):
            return i
        i = after_parens(i) if toks[i][0] == "open" else i + 1
    return n
