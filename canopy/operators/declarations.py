"""Declarations with their true end lines (C1): functions, classes and methods.

A scanner with lexical state reads each text once: strings, templates,
comments and brackets are skipped as such, so a keyword or brace inside them
opens nothing.  Bracketed languages end a declaration at the brace that closes
its body, indented ones before the first line that is indented no further.
Functions and classes are those at the top level, methods those of such a class.
The work is linear in a text and per row: no shuffle, one text in memory.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 1024             # declarations of an output batch
SCHEMA = pa.schema([("pos", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("owner", pa.string()),
                    ("start_line", pa.int32()), ("end_line", pa.int32()), ("text", pa.string())])


class Declaration(NamedTuple):
    kind: str               # function, class or method
    name: str | None
    owner: str | None       # a method's class
    start: int              # character of its first modifier or decorator
    end: int                # character after its last one


# ------------------------------------------------------------ bracketed

_WORD = r"[A-Za-z_$\x80-\U0010ffff][\w$]*+"
_BRACES = re.compile(rf"""
    (?P<skip>//[^\n]*+ | /\*(?:[^*]|\*(?!/))*+(?:\*/)?)
  | (?P<string>"(?:[^"\\\n]|\\.)*+"? | '(?:[^'\\\n]|\\.)*+'?)
  | (?P<word>\#?{_WORD}) | (?P<number>\d[\w.]*+) | (?P<mark>=>|[-+]{{2}}|[^\s\w])""", re.X | re.S)
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+(?:`|\$\{|\Z)", re.S)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/\w*+")
_MODIFIERS = {"export", "default", "async", "abstract", "declare"}
_BEFORE_VALUE = {"return", "typeof", "case", "in", "of", "do", "else", "void", "delete", "throw", "new", "await", "yield"}
_OPEN, _CLOSE = "([{", ")]}"


def _tokens(text: str):
    """(kind, characters, start, end) of everything but comments; a template counts as strings around its code."""
    at, before, nested, depth = 0, "", [], 0  # nested: brace depths at which a template goes on
    while m := _BRACES.search(text, at):
        kind, token, at = m.lastgroup, m.group(), m.end()
        if kind == "skip":
            continue
        resumed = False
        if token == "{":
            depth += 1
        elif token == "}":
            depth -= 1
            resumed = bool(nested) and nested[-1] == depth
        if token == "`" or resumed:
            if resumed:
                nested.pop()
            t = _TEMPLATE.match(text, at)
            at, kind = t.end(), "string"
            if t.group().endswith("${"):
                nested.append(depth)
                depth += 1
        elif token == "/" and (before in _BEFORE_VALUE or not before or before[-1] in "(,=:[!&|?{};+-*%<>~^"):
            if r := _REGEX.match(text, m.start()):
                at, kind = r.end(), "string"
        before = '"' if kind == "string" else token
        yield kind, token if kind != "string" else '"', m.start(), at


_MEMBER_WORDS = {"static", "async", "get", "set", "public", "private", "protected", "readonly", "abstract", "override", "declare"}


def _ended(before: str) -> bool:
    """Whether a line may end a statement after this token."""
    return before == '"' or before in (")", "]", "}", ">") or before[-1:].isalnum() or before[-1:] in ("_", "$")


class _Frame:
    """What is known of the member or statement now read, at the top level or in a class body."""

    def __init__(self, owner: Declaration | None, depth: int):
        self.owner, self.depth = owner, depth
        self.clear()

    def clear(self) -> None:
        self.start = None       # where it begins
        self.kind = None        # function or class, once its keyword is read
        self.name = None
        self.value = False      # an initialiser or expression: nothing is declared any more
        self.params = False     # its parameters have been read
        self.called = False     # a member with parameters
        self.block = False      # a block statement is open
        self.word = None        # the last word, which may be a member's name
        self.bracket = None     # where a computed name starts
        self.decorator = 0      # 1 after the sign, 2 after its name, 3 after its arguments
        self.angles = 0         # open type parameters: braces there belong to a type


def bracketed(text: str) -> list[Declaration]:
    """Declarations of a text with braces; one that is never closed runs to the end."""
    out: list[Declaration] = []
    frames = [_Frame(None, 0)]
    open_bodies: list[tuple[int, int]] = []     # (depth, number) of the declarations whose bodies are open
    depth, before, last_end, decorating = 0, "", 0, None

    def bodiless(f: _Frame, end: int) -> None:
        out.append(Declaration(f.kind or "method", f.name, f.owner.name if f.owner else None, f.start, end))

    for kind, token, start, end in _tokens(text):
        f = frames[-1]
        here = depth == f.depth
        if here and f.start is not None and kind == "word" and not f.decorator and _ended(before) and "\n" in text[last_end:start]:
            # the line before may have been the last one of a declaration without a body, of a statement or of a field
            if f.params and not f.value and (f.owner is not None or f.kind == "function"):
                bodiless(f, last_end)
                f.clear()
            elif f.value or f.owner is not None and f.kind is None and not f.params and before not in _MEMBER_WORDS:
                f.clear()
        if here and f.start is None and token not in ";}":
            f.start = start
        if token in _OPEN:
            if token == "{" and here and not f.value:
                if f.angles or f.params and before in (":", "|", "&"):
                    pass  # a type
                elif f.kind or (f.owner is not None and f.params):
                    what = f.kind or "method"
                    out.append(Declaration(what, f.name, f.owner.name if f.owner else None, f.start, len(text)))
                    open_bodies.append((depth, len(out) - 1))
                    f.clear()
                    if what == "class":
                        frames.append(_Frame(out[-1], depth + 1))
                else:
                    f.value, f.block = True, f.owner is None or before == "static"
            elif token == "[" and here and f.owner is not None and not f.value:
                f.word, f.bracket = None, start
            elif token == "(" and here and not f.value:
                if f.decorator == 2:
                    decorating = depth
                elif f.owner is not None and f.kind is None and not f.params and f.name is None:
                    f.name, f.called = f.word, True
            depth += 1
        elif token in _CLOSE:
            depth -= 1
            if len(frames) > 1 and depth < frames[-1].depth:
                frames.pop()
            f = frames[-1]
            if open_bodies and open_bodies[-1][0] >= depth and token == "}":
                number = open_bodies.pop()[1]
                out[number] = out[number]._replace(end=end)
            elif token == ")" and depth == f.depth and not f.value:
                if decorating == depth:
                    decorating, f.decorator = None, 3
                elif f.kind == "function" or f.called:
                    f.params = True
            elif token == "]" and depth == f.depth and f.bracket is not None:
                f.word, f.bracket = text[f.bracket:end], None
            elif token == "}" and depth == f.depth and f.block:
                f.clear()  # what follows a block statement is a new one
        elif here:
            if token == ";":
                if f.params and not f.value and (f.owner is not None or f.kind == "function"):
                    bodiless(f, end)
                f.clear()
            elif token == "@":
                f.decorator = 1
            elif token in "<>" and not f.value and (f.kind or f.owner is not None):
                f.angles = max(0, f.angles + (1 if token == "<" else -1))
            elif kind == "word":
                if f.decorator and before in ("@", "."):
                    f.decorator = 2
                elif f.value:
                    pass
                else:
                    f.decorator = 0
                    if f.kind and f.name is None:
                        f.name = token
                    elif f.kind is None and f.owner is None:
                        if token in ("function", "class"):
                            f.kind = token
                        elif token not in _MODIFIERS:
                            f.value = True
                    f.word = f.word if f.angles else token
            elif f.owner is not None and f.kind is None and kind in ("string", "number"):
                f.word = text[start:end]
            elif token == "=" and not (f.kind or f.params) or f.owner is None and not f.kind and token not in "@.":
                f.value = True
            elif f.owner is not None and f.kind is None and not f.params and token in ":=":
                f.value = True
        before, last_end = token, end
    return out


# ------------------------------------------------------------ indented

_INDENTED = re.compile(r'''
    (?P<skip>\#[^\n]*+ | \\\n)
  | (?P<string>"""(?:[^"\\]|\\.|"(?!""))*+(?:""")? | \'\'\'(?:[^'\\]|\\.|'(?!\'\'))*+(?:\'\'\')?
      | "(?:[^"\\\n]|\\.)*+"? | '(?:[^'\\\n]|\\.)*+'?)
  | (?P<line>\n) | (?P<open>[(\[{]) | (?P<close>[)\]}]) | (?P<other>[^\s\#"'()\[\]{}\\]++|\\)''', re.X | re.S)
_HEADER = re.compile(r"(?:async\s+)?(def|class)\s+(\w+)")


def _statements(text: str):
    """(start, end) of the logical lines: no line ends inside brackets or strings."""
    depth, start, end = 0, None, 0
    for m in _INDENTED.finditer(text):
        kind = m.lastgroup
        if kind == "line":
            if depth == 0 and start is not None:
                yield start, end
                start = None
            continue
        if kind == "skip":
            continue
        start = m.start() if start is None else start
        end = m.end()
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth = max(0, depth - 1)
    if start is not None:
        yield start, end


def indented(text: str) -> list[Declaration]:
    """Declarations of a text with indented bodies; decorators belong to what follows them."""
    out: list[Declaration] = []
    open_ones: list[list] = []      # [indent, number, indent of its body or None]
    decorated = None
    for start, end in _statements(text):
        line = text.rfind("\n", 0, start) + 1
        indent = len(text[line:start].expandtabs(8))
        while open_ones and indent <= open_ones[-1][0]:
            open_ones.pop()
        for entry in open_ones:
            out[entry[1]] = out[entry[1]]._replace(end=end)
        if open_ones and open_ones[-1][2] is None:
            open_ones[-1][2] = indent
        if text[start] == "@":
            decorated = start if decorated is None else decorated
            continue
        first, decorated = start if decorated is None else decorated, None
        m = _HEADER.match(text, start)
        if not m:
            continue
        owner = out[open_ones[-1][1]] if open_ones else None
        if indent == 0:
            kind = "class" if m[1] == "class" else "function"
        elif m[1] == "def" and owner is not None and owner.kind == "class" and indent == open_ones[-1][2]:
            kind = "method"
        else:
            continue
        out.append(Declaration(kind, m[2], owner.name if kind == "method" else None, first, end))
        open_ones.append([indent, len(out) - 1, None])
    return out


SCANNERS = {"typescript": bracketed, "python": indented}


# ------------------------------------------------------------ rows

def chunks(text: str, language: str | None, rest: bool = False):
    """(kind, name, owner, start_line, end_line, text) of a text's declarations, by their start.

    ``rest``: the lines in no declaration come too, as pieces of kind rest, so no line is lost.
    """
    scan = SCANNERS.get(language)
    found = scan(text) if scan else []
    lines = text.split("\n")
    number, at, done = 0, 0, 0
    for d in found:  # starts ascend
        number += text.count("\n", at, d.start)
        at = d.start
        last = number + text.count("\n", d.start, d.end)
        if d.kind != "method":
            if rest and number > done:
                yield "rest", None, None, done, number - 1, "\n".join(lines[done:number])
            done = max(done, last + 1)
        yield d.kind, d.name, d.owner, number, last, "\n".join(lines[number:last + 1])
    if rest and done < len(lines):
        yield "rest", None, None, done, len(lines) - 1, "\n".join(lines[done:])


def declarations(files: DataFrame, key: str = "file_id", language_col: str = "language", text_col: str = "text",
                 rest: bool = False) -> DataFrame:
    """A row per declaration: ``key, pos, kind, name, owner, start_line, end_line, text``, lines from 0.

    ``pos`` counts a text's rows in order.  Languages without a scanner, null
    and empty texts have no declaration (``chunk_fallback`` takes whole files);
    with ``rest`` their lines are one piece, null texts none.  Only the three
    columns are read; repeated rows and null keys are scanned each for itself.
    """
    source = files.select(F.col(key), F.col(language_col).alias("language"), F.col(text_col).cast("string").alias("text"))
    out = source.select(key).schema.simpleString()[len("struct<"):-1].replace(":", " ", 1)
    out += ", pos int, kind string, name string, owner string, start_line int, end_line int, text string"

    def run(batches):
        for batch in batches:
            where, rows = [], []

            def made():
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)]
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), *columns],
                                                  names=[key, *SCHEMA.names])

            for i, (language, text) in enumerate(zip(batch.column(1), batch.column(2))):
                if text.is_valid:
                    for pos, row in enumerate(chunks(text.as_py(), language.as_py(), rest)):
                        where.append(i)
                        rows.append((pos, *row))
                        if len(rows) >= ROWS:
                            yield made()
                            where, rows = [], []
            if rows:
                yield made()

    return source.mapInArrow(run, out)
