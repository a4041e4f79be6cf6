"""One linear pass over a source file: strings and comments masked, brackets matched, declarations closed as their blocks end.

This is the helper of ``operators.extract`` and ``operators.security``. It runs inside Arrow batches of files and returns small
structs only; Spark spreads the files, and everything that is computed from the structs are columns.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

#: ``n`` to ``end``: lines of the declaration, of the end of its header and of its block. ``params``: as written, brackets
#: included; for Python the header without its comments.
DECLARATION = (
    "n int, ind int, kind string, name string, sig_end int, end int, params string, returns string, "
    "outer_kind string, outer_name string, outer_ind int, decorators array<string>"
)
#: Handlers of all exceptions: what is caught, whether the block is ``pass`` alone or holds it, and the function or class around.
HANDLER = "n int, end int, caught string, only_pass boolean, has_pass boolean, x string, entity string"
#: A line with a keyword up to the line that closes its brackets, as written and masked, and the function or class around.
STATEMENT = "n int, x string, masked string, entity string"

_QUOTED = r"""\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?"""
_REGEX = r"(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
#: Every alternative begins with one given character, so that the search skips to these.
_SKIPPED = {
    True: re.compile("|".join(q + r"(?:[^\\]|\\.)*?(?:" + q + r"|\Z)" for q in ('"""', "'''")) + "|" + _QUOTED + r"|#[^\n]*", re.S),
    False: re.compile(
        r"//[^\n]*|/\*.*?(?:\*/|\Z)|" + _QUOTED + r"|`(?:[^`\\]|\\.)*(?:`|\Z)"
        + "".join(f"|{c}(?<=[=(,:;!&|?{{}}\\[]{c}){rest}{_REGEX}" for c, rest in (("/", ""), (" ", r"[ \t]*/"), (r"\t", r"[ \t]*/"))), re.S),
}
_EVENT = re.compile(r"[\n()\[\]{}]")
_COLON = re.compile(r"[\n()\[\]{}:]")
_INK = re.compile(r"\S")
_ANGLE, _ENDED, _UP_TO_VALUE, _GOES_ON = map(re.compile, (r"[<>;]", r"[;\n)\]}([{]", r"[=;\n([{]", r"\s*[=|&?:.+]"))

PY_HANDLER = re.compile(r"\s*except\s*(?:\(?\s*(Exception|BaseException)\s*\)?(?:\s+as\s+\w+)?\s*)?:")
PY_DECLARATION = re.compile(r"([ \t]*)((?:async\s+)?def|class)\s+([A-Za-z_]\w*)")
_EXPORT = r"\s*(?:export\s+)?(?:default\s+)?"
_NAME = r"([A-Za-z_$][\w$]*)"
JS_DECLARATION = re.compile(
    rf"{_EXPORT}(?:async\s+)?function\s*\*?\s*{_NAME}|{_EXPORT}class\s+{_NAME}|{_EXPORT}interface\s+{_NAME}|\s*(?:export\s+)?type\s+{_NAME}\s*(?=[<=])"
    rf"|\s*(?:export\s+)?(?:const|let|var)\s+{_NAME}"
)
JS_KINDS = ("function", "class", "interface", "type_alias", "arrow")
JS_METHOD = re.compile(
    r"\s*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*\*?\s*"
    r"(?!(?:if|for|while|switch|catch|function|return|await|throw|new)\b)(#?[A-Za-z_$][\w$]*)\s*(?=[<(])"
)
_VALUE = re.compile(r"\s*(?:async\s+)?(?:function\s*\*?\s*[\w$]*\s*)?(?=[(<])")
_SINGLE = re.compile(r"\s*(?:async\s+)?[A-Za-z_$][\w$]*\s*(?==>)")


def _masked(s: str) -> str:
    """A string keeps its quotes around placeholders, a comment becomes blanks; line ends stay."""
    if s[0] not in "\"'`":
        return " " * len(s) if "\n" not in s else re.sub(r"[^\n]", " ", s)
    inner = s[1:-1] if len(s) > 1 and s[-1] == s[0] else s[1:]
    filled = "x" * len(inner) if "\n" not in inner else re.sub(r"[^\n]", "x", inner)
    return s[0] + filled + (s[0] if len(inner) < len(s) - 1 else "")


class Source:
    """``masked`` text and its ``lines``; per line whether it begins ``inside`` a string or comment, the bracket depth
    ``before`` it, and the line in which the brackets it opens are ``closed``; ``pairs``: the closing place of a bracket."""

    def __init__(self, text: str, python: bool):
        pieces, breaks, at = [], [], 0
        for m in _SKIPPED[python].finditer(text):
            s = m.group()
            pieces += (text[at : m.start()], _masked(s))
            at = m.end()
            if "\n" in s:
                breaks.append((m.start(), s.count("\n")))
        self.text, self.masked = text, "".join([*pieces, text[at:]])
        self.lines = self.masked.split("\n")
        self.starts, at = [], 0
        for line in self.lines:
            self.starts.append(at)
            at += len(line) + 1
        self.inside = bytearray(len(self.lines))
        for place, k in breaks:
            line = bisect_right(self.starts, place)
            self.inside[line : line + k] = b"\1" * k
        #: Lines with code, and those inside a string or comment; the others are blank or comments.
        self.inked = [i for i, line in enumerate(self.lines) if self.inside[i] or line and not line.isspace()]
        self.pairs: dict[int, int] = {}
        self.before, open_ = [0], []
        for m in _EVENT.finditer(self.masked):
            c = m.group()
            if c == "\n":
                self.before.append(len(open_))
            elif c in "([{":
                open_.append(m.start())
            elif open_:
                self.pairs[open_.pop()] = m.start()
        self.closed = list(range(len(self.lines)))
        waiting = []
        for i, (depth, after) in enumerate(zip(self.before, [*self.before[1:], len(open_)])):
            if depth < after:
                if not self.inside[i]:
                    waiting.append(i)
            else:
                while waiting and self.before[waiting[-1]] >= after:
                    self.closed[waiting.pop()] = i

    def line_of(self, place: int, near: int) -> int:
        """The line of a place at or after line ``near``."""
        return near + self.masked.count("\n", self.starts[near], place)

    def bracketed(self, start: int, end: int) -> int:
        """The place after the bracket that opens at ``start``, or ``end`` if it stays open."""
        return self.pairs.get(start, end - 1) + 1

    # ---- Python ----

    def python(self) -> list[tuple]:
        """``def`` and ``class`` with the ends of their headers and blocks; a block ends at its last line of code."""
        done, open_, marks, last, header_end = [], [], [], 0, -1
        for i in self.inked:
            if not self.inside[i] and not self.before[i] and i > header_end:
                line = self.lines[i]
                indent = _INK.search(line).start()
                while open_ and open_[-1][1] >= indent:
                    done.append((*open_.pop(), last + 1))
                m = PY_DECLARATION.match(line)
                if m:
                    header_end = self._header_end(i, m.end())
                    kind, outer = re.sub(r"\s+", " ", m.group(2)), open_[-1] if open_ else (None,) * 4
                    open_.append((i + 1, len(m.group(1)), kind, m.group(3), header_end + 1, outer[2], outer[3], outer[1], marks))
                marks = [*marks, self._decorator(i)] if line[indent] == "@" else []
            last = max(i, header_end)
        done += [(*d, last + 1) for d in open_]
        return [(*d[:5], max(d[-1], d[4]), self._uncommented(d[0] - 1, d[4] - 1), None, *d[5:9]) for d in sorted(done, key=lambda d: d[0])]

    def _uncommented(self, first: int, last: int) -> str:
        """Lines as written, with blanks for their comments."""
        a, b = self.starts[first], self.starts[last] + len(self.lines[last])
        if "#" not in self.text[a:b]:
            return self.text[a:b]
        return "".join(" " if m == " " else t for t, m in zip(self.text[a:b], self.masked[a:b]))

    def _decorator(self, i: int) -> str:
        """A decorator in one line."""
        end = self.starts[self.closed[i]] + len(self.lines[self.closed[i]].rstrip())
        parts = [x.strip() for x in self.text[self.starts[i] : end].split("\n")]
        return re.sub(r",?\s*([)\]}])$", r"\1", re.sub(r"([(\[{]) ", r"\1", " ".join(parts))) if len(parts) > 1 else parts[0]

    def handlers(self, declared: list[tuple]) -> list[tuple]:
        """Bare handlers and those of ``Exception`` and ``BaseException``."""
        raw, done, open_, last = self.text.split("\n"), [], [], 0
        owner = self.owners(declared)

        def close(h: dict) -> tuple:
            only = h["pass"] if h["inline"] or h["lines"] == 1 else False
            return h["n"], max(h["last"], h["n"]), h["caught"], only, h["pass"], raw[h["n"] - 1], owner[h["n"] - 1]

        for i in self.inked:
            if not self.inside[i] and not self.before[i]:
                line = self.lines[i]
                indent = _INK.search(line).start()
                while open_ and open_[-1]["ind"] >= indent:
                    done.append(close(open_.pop()))
                for h in open_:
                    h["first"] = indent if h["first"] is None else h["first"]
                    h["pass"] |= indent == h["first"] and line.strip() == "pass"
                m = PY_HANDLER.match(line)
                if m:
                    rest = line[m.end() :].strip()
                    for h in open_:
                        h["lines"], h["last"] = h["lines"] + 1, i + 1
                    open_.append({"n": i + 1, "ind": indent, "caught": m.group(1), "inline": rest == "pass", "pass": rest == "pass", "first": None, "lines": 0, "last": 0})
                    continue
            for h in open_:
                h["lines"], h["last"] = h["lines"] + 1, i + 1
        return sorted(done + [close(h) for h in open_], key=lambda h: h[0])

    def owners(self, declared: list[tuple]) -> list[str | None]:
        """Per line the name of the innermost declaration around it."""
        owner: list[str | None] = [None] * len(self.lines)
        for d in declared:  # outer ones come first
            owner[d[0] - 1 : d[5]] = [d[3]] * (d[5] - d[0] + 1)
        return owner

    def _header_end(self, i: int, column: int) -> int:
        """The line with the colon outside of brackets, or the last one that a broken header reaches."""
        at, line = self.starts[i] + column, i
        while True:
            m = _COLON.search(self.masked, at)
            if m is None or m.group() in ":)]}":
                return line
            if m.group() == "\n":
                if not self.lines[line].endswith("\\"):
                    return line
                line, at = line + 1, m.end()
            elif m.start() in self.pairs:
                at = self.pairs[m.start()]
                line, at = line + self.masked.count("\n", m.start(), at), at + 1
            else:
                return line

    # ---- JavaScript and TypeScript ----

    def script(self) -> list[tuple]:
        """Functions, classes, interfaces, types and function-valued variables outside of functions, classes and types, and
        the methods of those classes."""
        skip_to, end, body, done = -1, len(self.masked), None, []
        for i in self.inked:
            if self.inside[i]:
                continue
            line = self.lines[i]
            if body is not None and i > body[2]:
                body = None
            if body is not None:
                m = JS_METHOD.match(line) if self.before[i] == body[1] and i > body[0] and i > skip_to else None
                found = self._function(i, m.end(), "{") if m else None
                if found:
                    sig_end, last, params, returns = found
                    skip_to = last
                    done.append((i + 1, _indent(line), "method", m.group(1), sig_end + 1, last + 1, params, returns, *body[3], []))
                continue
            m = JS_DECLARATION.match(line) if i > skip_to else None
            if not m:
                continue
            kind, at = JS_KINDS[m.lastindex - 1], self.starts[i] + m.end()
            name, params, returns = m.group(m.lastindex), None, None
            if kind in ("function", "arrow"):
                found = self._function(i, m.end(), "{") if kind == "function" else self._value(i, m.end())
                if not found:
                    continue
                sig_end, last, params, returns = found
                if kind == "function":
                    skip_to = last
            elif kind == "type_alias":
                sig_end, last = i, self._expression_end(i, at)
                skip_to = last
            else:
                brace = self.masked.find("{", at)
                sig_end = self.line_of(brace, i) if brace >= 0 else i
                last = self.line_of(self.pairs.get(brace, end), sig_end) if brace >= 0 else i
                if kind == "class" and last > sig_end:
                    body = (sig_end, self.before[sig_end] + 1, last, ("class", name, _indent(line)))
                else:
                    skip_to = last
            done.append((i + 1, _indent(line), kind, name, sig_end + 1, last + 1, params, returns, None, None, None, []))
        return done

    def _past_generics(self, at: int) -> int:
        if self.masked[at : at + 1] != "<":
            return at
        depth = 0
        for m in _ANGLE.finditer(self.masked, at):
            c = m.group()
            if c == "<":
                depth += 1
            elif c == ">" and self.masked[m.start() - 1] != "=":
                depth -= 1
            elif c == ";":
                return at
            if not depth:
                return m.end()
        return at

    def _function(self, i: int, column: int, opener: str) -> tuple[int, int, str, str | None] | None:
        """From behind a name: last line of the header, last line, parameters as written, return type. ``opener``: ``{`` or ``=>``."""
        at = self._skip_blanks(self.starts[i] + column)
        at = self._skip_blanks(self._past_generics(at))
        if self.masked[at : at + 1] != "(" or at not in self.pairs:
            return None
        params, at = self.text[at : self.pairs[at] + 1], self._skip_blanks(self.pairs[at] + 1)
        returns = None
        if self.masked[at : at + 1] == ":":
            start = at = self._skip_blanks(at + 1)
            at = self._type_end(at, opener)
            returns = self.text[start:at].strip() or None
        if not self.masked.startswith(opener, at):
            return None
        sig_end = self.line_of(at, i)
        if opener == "=>":
            at = self._skip_blanks(at + 2)
            if self.masked[at : at + 1] != "{":
                return sig_end, self._expression_end(self.line_of(at, i), at), params, returns
        return sig_end, self.line_of(self.pairs.get(at, len(self.masked)), sig_end), params, returns

    def _type_end(self, at: int, opener: str) -> int:
        """Where a return type ends: at the opener, outside of brackets; an object type may begin it or follow a bar."""
        want_type = True
        while at < len(self.masked):
            c = self.masked[at]
            if c == "{" and opener == "{" and not want_type:
                return at
            if self.masked.startswith("=>", at):
                if opener == "=>":
                    return at
                want_type, at = True, at + 2
                continue
            if c in ";)]}":
                return at
            if c in "([{":
                at, want_type = self.bracketed(at, len(self.masked)), False
                continue
            if c in "|&<,":
                want_type = True
            elif not c.isspace():
                want_type = False
            at += 1
        return at

    def _value(self, i: int, column: int) -> tuple[int, int, str, str | None] | None:
        """A variable's value, if it is a function."""
        at = self.starts[i] + column
        while True:  # past the type, up to the equals sign
            m = _UP_TO_VALUE.search(self.masked, at)
            if m is None or m.group() == ";":
                return None
            if m.group() in "([{":
                at = self.bracketed(m.start(), len(self.masked))
            elif m.group() == "\n":
                if not _GOES_ON.match(self.masked, m.end()) and not self.masked.endswith((":", "|", "&"), at, m.start()):
                    return None
                at = m.end()
            elif self.masked[m.end() : m.end() + 1] == ">":
                at = m.end() + 1
            else:
                at = m.end()
                break
        single = _SINGLE.match(self.masked, at)
        if single:
            arrow = self._skip_blanks(single.end()) + 2
            line, body = self.line_of(arrow, i), self._skip_blanks(arrow)
            if self.masked[body : body + 1] == "{":
                return line, self.line_of(self.pairs.get(body, len(self.masked)), line), "()", None
            return line, self._expression_end(self.line_of(body, i), body), "()", None
        m = _VALUE.match(self.masked, at)
        if not m:
            return None
        line = self.line_of(m.end(), i)
        opener = "{" if "function" in m.group() else "=>"
        return self._function(line, m.end() - self.starts[line], opener)

    def _skip_blanks(self, at: int) -> int:
        m = _INK.search(self.masked, at)
        return m.start() if m else len(self.masked)

    def _expression_end(self, i: int, at: int) -> int:
        """The line where an expression from ``at`` in line ``i`` ends: at a semicolon, or a line end that leaves nothing open."""
        while True:
            m = _ENDED.search(self.masked, at)
            if m is None:
                return len(self.lines) - 1 if self.lines[-1].strip() else max(i, len(self.lines) - 2)
            c = m.group()
            if c in "([{":
                end = self.bracketed(m.start(), len(self.masked))
                i, at = i + self.masked.count("\n", m.start(), end), end
            elif c == "\n":
                if self.masked[at : m.start()].rstrip().endswith(("|", "&", "=", "?", ":", "=>", "+", ".")) or _GOES_ON.match(self.masked, m.end()):
                    i, at = i + 1, m.end()
                else:
                    return i
            else:
                return i

    # ---- statements ----

    def statements(self, keyword: re.Pattern, declared: list[tuple] | None) -> list[tuple]:
        """Lines of code with a keyword, each up to the line that closes its brackets. ``declared``: of a Python file."""
        raw, found = self.text.split("\n"), []
        owner = None if declared is None else self.owners(declared)
        for i in self.inked:
            if self.inside[i] or not keyword.search(raw[i]):
                continue
            end = self.closed[i] + 1
            found.append((i + 1, "\n".join(raw[i:end]), "\n".join(self.lines[i:end]), owner[i] if owner else None))
        return found


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


_KINDS = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _rows(schema: str) -> tuple[list[str], pa.DataType]:
    fields = [x.split(" ") for x in schema.split(", ")]
    return [name for name, _ in fields], pa.list_(pa.struct([(name, _KINDS[kind]) for name, kind in fields]))


def _structs(schema: str) -> str:
    return "array<struct<" + schema.replace(" ", ":").replace(",:", ",") + ">>"


def _sources(texts: pa.Array, languages: pa.Array) -> Iterator[tuple[Source | None, bool]]:
    for text, language in zip(texts, languages):
        text, language = text.as_py(), language.as_py()
        known = text is not None and language in ("Python", "JavaScript", "TypeScript")
        yield (Source(text, language == "Python") if known else None), language == "Python"


def scanned(lines: Column, language: Column) -> Column:
    """``struct<decls, handlers>`` of a Python, JavaScript or TypeScript file, in line order; empty for other languages."""
    (declared, kind), (caught, handler_kind) = _rows(DECLARATION), _rows(HANDLER)

    @F.arrow_udf(f"struct<decls:{_structs(DECLARATION)},handlers:{_structs(HANDLER)}>")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        decls, handlers = [], []
        for source, python in _sources(texts, languages):
            found = [] if source is None else source.python() if python else source.script()
            decls.append([dict(zip(declared, d)) for d in found])
            broad = source.handlers(found) if python and source and "except" in source.masked else []
            handlers.append([dict(zip(caught, h)) for h in broad])
        return pa.StructArray.from_arrays([pa.array(decls, kind), pa.array(handlers, handler_kind)], names=["decls", "handlers"])

    return run(F.array_join(lines, "\n"), language)


def statements(lines: Column, language: Column, python_keyword: str, script_keyword: str) -> Column:
    """``STATEMENT`` rows of a file, those whose first line matches a keyword."""
    (names, kind), words = _rows(STATEMENT), {True: re.compile(python_keyword), False: re.compile(script_keyword)}

    @F.arrow_udf(_structs(STATEMENT))
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        found = [s.statements(words[python], s.python() if python else None) if s else [] for s, python in _sources(texts, languages)]
        return pa.array([[dict(zip(names, row)) for row in rows] for rows in found], kind)

    return run(F.array_join(lines, "\n"), language)


def _read(texts: pa.Array, languages: pa.Array, words: dict[bool, re.Pattern]) -> Iterator[tuple[list[dict], list[dict]]]:
    """Per file its statements and handlers, from one :class:`Source`."""
    (names, _), (caught, _) = _rows(STATEMENT), _rows(HANDLER)
    for source, python in _sources(texts, languages):
        declared = source.python() if source and python else None
        found = source.statements(words[python], declared) if source else []
        broad = source.handlers(declared) if declared is not None and "except" in source.masked else []
        yield [dict(zip(names, r)) for r in found], [dict(zip(caught, h)) for h in broad]


def statements_with_handlers(lines: Column, language: Column, python_keyword: str, script_keyword: str) -> Column:
    """``struct<statements, handlers>`` of a file, scanned once: those of :func:`statements` and of :func:`scanned`."""
    (_, statement), (_, handler) = _rows(STATEMENT), _rows(HANDLER)
    words = {True: re.compile(python_keyword), False: re.compile(script_keyword)}

    @F.arrow_udf(f"struct<statements:{_structs(STATEMENT)},handlers:{_structs(HANDLER)}>")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        found = [*_read(texts, languages, words)]
        return pa.StructArray.from_arrays(
            [pa.array([f for f, _ in found], statement), pa.array([h for _, h in found], handler)], names=["statements", "handlers"])

    return run(F.array_join(lines, "\n"), language)


def statements_and_handlers(lines: Column, language: Column, python_keyword: str, script_keyword: str) -> Column:
    """``array<struct<r, h>>`` of a file, scanned once: its :func:`statements`, then the handlers of :func:`scanned`."""
    (_, statement), (_, handler) = _rows(STATEMENT), _rows(HANDLER)
    words = {True: re.compile(python_keyword), False: re.compile(script_keyword)}
    kind = pa.list_(pa.struct([("r", statement.value_type), ("h", handler.value_type)]))
    struct = lambda schema: _structs(schema)[len("array<") : -1]

    @F.arrow_udf(f"array<struct<r:{struct(STATEMENT)},h:{struct(HANDLER)}>>")
    def run(texts: pa.Array, languages: pa.Array) -> pa.Array:
        read = _read(texts, languages, words)
        return pa.array([[{"r": r, "h": None} for r in found] + [{"r": None, "h": h} for h in broad] for found, broad in read], kind)

    return run(F.array_join(lines, "\n"), language)
