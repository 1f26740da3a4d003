"""Declarations, metrics and logic blocks of Go source (C-09 to C-18), by a small scanner.

Strings, runes and comments are blanked first, so braces and names are code; declarations are what begins at
depth 0.  A source whose brackets don't match raises ParseError.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: Token bounds of declarations and of types, and the largest comment ratio.
LEAST, LEAST_TYPE, MOST, MOST_COMMENTS = 10, 5, 1600, 0.95
#: When a function is split, and the token bounds of its pieces.
SPLIT_LINES, SPLIT_COMPLEXITY, LEAST_LOGIC, MOST_LOGIC = 100, 15, 50, 800
#: First segments of standard import paths.
STANDARD = frozenset(
    """archive bufio builtin bytes compress container context crypto database debug embed encoding errors expvar flag fmt go hash html
    image index io log math mime net os path plugin reflect regexp runtime sort strconv strings sync syscall testing text time
    unicode unsafe""".split()
)
_KEYWORDS = {"if", "for", "switch", "select", "func", "return", "go", "defer", "case", "range", "make", "new", "append", "len", "cap", "panic", "copy", "delete", "close", "recover", "print", "println"}
_BASIC = {"string", "bool", "byte", "rune", "error", "any", "int", "int8", "int16", "int32", "int64", "uint", "uint8", "uint16", "uint32", "uint64", "uintptr", "float32", "float64", "complex64", "complex128", "interface", "struct", "map", "chan", "func"}
_NOISE = re.compile(r"//[^\n]*|/\*.*?\*/|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'", re.S)
_FUNC = re.compile(r"func\s*(?:\(\s*(?:\w+\s+)?\*?\s*(\w+)(?:\[[^\]]*\])?\s*\)\s*)?(\w+)")
_TYPE = re.compile(r"(\w+)(?:\[[^\]]*\])?\s+(struct|interface)?")


class ParseError(ValueError):
    """A source whose brackets don't match."""


@dataclass
class Declaration:
    kind: str
    name: str | None
    start: int
    end: int
    text: str
    parent: str | None = None
    signature: str | None = None
    doc: str | None = None
    tokens: int = 0
    level: int = 2
    calls: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)


def blank(source: str) -> str:
    """The source with strings and comments as white space; lines stay where they are."""
    return _NOISE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), source)


def _depths(code: str) -> list[int]:
    """Bracket depth at the start of each line, and after the last."""
    pairs, stack, out = {")": "(", "]": "[", "}": "{"}, [], [0]
    for c in code:
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() != pairs[c]:
                raise ParseError(f"unmatched {c!r} in line {len(out)}")
        elif c == "\n":
            out.append(len(stack))
    if stack:
        raise ParseError(f"{stack[-1]!r} is not closed")
    return [*out, 0]


def _doc(lines: list[str], start: int) -> str | None:
    found = []
    for line in reversed(lines[:start]):
        if not line.strip().startswith("//"):
            break
        found.append(line.strip()[2:].strip())
    return "\n".join(reversed(found)) or None


def declarations(source: str) -> Iterator[Declaration]:
    """C-09: the package clause and everything declared at depth 0, in order; a group gives each of its types."""
    code = blank(source)
    depths, lines, clean = _depths(code), source.split("\n"), code.split("\n")
    i = 0
    while i < len(clean):
        word = clean[i].split(None, 1)[0].split("(")[0] if clean[i].strip() else ""
        if depths[i] or word not in ("package", "func", "type", "const", "var", "import"):
            i += 1
            continue
        end = i
        while end + 1 < len(clean) and depths[end + 1]:
            end += 1
        body = "\n".join(clean[i : end + 1])
        yield from _declared(word, body, lines, clean, i, end)
        i = end + 1


def _declared(word: str, body: str, lines: list[str], clean: list[str], start: int, end: int) -> Iterator[Declaration]:
    text, doc = "\n".join(lines[start : end + 1]), _doc(lines, start)
    if word == "package":
        yield Declaration("package", (body.split() + [None, None])[1], start + 1, end + 1, text, doc=doc)
    elif word == "func" and (m := _FUNC.match(body.strip())):
        head = _head(body)
        yield Declaration("method" if m[1] else "function", m[2], start + 1, end + 1, text, m[1], signature(head), doc, calls=calls(body[len(head) :]), types=types(head))
    elif word == "type":
        inside = body.strip()[4:].strip()
        if not inside.startswith("("):
            if m := _TYPE.match(inside):
                yield Declaration(m[2] or "type", m[1], start + 1, end + 1, text, doc=doc, types=types(inside[len(m[1]) :]))
            return
        depth, first = 1, None
        for k in range(start + 1, end):
            if depth == 1 and clean[k].strip():
                first = k
            depth += sum(clean[k].count(c) for c in "([{") - sum(clean[k].count(c) for c in ")]}")
            if depth == 1 and first is not None and (m := _TYPE.match(clean[first].strip())):
                part = "\n".join(clean[first : k + 1]).strip()
                yield Declaration(m[2] or "type", m[1], first + 1, k + 1, "\n".join(lines[first : k + 1]), doc=_doc(lines, first), types=types(part[len(m[1]) :]))
                first = None
    elif word in ("const", "var"):
        name = re.match(rf"{word}\s*\(?\s*(\w+)", body)
        yield Declaration(word, name[1] if name else None, start + 1, end + 1, text, doc=doc)


def _head(body: str) -> str:
    """What stands before a function's body: braces inside brackets, or of an interface or a struct, are the head's."""
    depth = 0
    for i, c in enumerate(body):
        if c == "{" and not depth and not re.search(r"(?:interface|struct)\s*$", body[:i]):
            return " ".join(body[:i].split()) if "\n" not in body[:i] else body[:i]
        depth += (c in "([{") - (c in ")]}")
    return body


def imports(source: str) -> dict[str, list[str]]:
    """C-10: import paths, standard and external, sorted."""
    found: set[str] = set()
    code = re.sub(r"//[^\n]*|/\*.*?\*/", "", source, flags=re.S)
    for group in re.findall(r"^import\s*\((.*?)\)", code, re.M | re.S):
        found |= set(re.findall(r'"([^"]+)"', group))
    found |= set(re.findall(r'^import\s+(?:[\w.]+\s+)?"([^"]+)"', code, re.M))
    standard = {p for p in found if is_standard(p)}
    return {"standard": sorted(standard), "external": sorted(found - standard)}


def is_standard(path: str) -> bool:
    """A path of the standard library: by its first segment, which no other module's is, as those name a host."""
    first, _, rest = path.partition("/")
    return first in STANDARD or "." not in path or (first, rest[:2]) == ("golang.org", "x/")


def _parts(code: str) -> list[str]:
    """What stands between commas outside all brackets."""
    out, depth = [""], 0
    for c in code:
        depth += (c in "([{") - (c in ")]}")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [p.strip() for p in out if p.strip()]


def _closing(code: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes."""
    depth = 0
    for i in range(at, len(code)):
        depth += (code[i] in "([{") - (code[i] in ")]}")
        if not depth:
            return i
    return len(code)


def type_name(code: str) -> str:
    """A type in a signature: names, pointers, slices, arrays, maps and empty interfaces; any other is unknown."""
    code = code.strip()
    if code.startswith("*"):
        return "*" + type_name(code[1:])
    if code.startswith("map["):
        end = _closing(code, 3)
        return f"map[{type_name(code[4:end])}]{type_name(code[end + 1 :])}"
    if code.startswith("["):
        return "[]" + type_name(code[_closing(code, 0) + 1 :])
    if re.fullmatch(r"interface\s*\{.*\}", code, re.S):
        return "interface{}"
    return code if re.fullmatch(r"\w+(\.\w+)?", code) else "unknown"


def fields(code: str) -> str:
    """Parameters or results: 'name type' for each name, or the types where they have no names."""
    parts = [re.match(r"(\w+)(?:\s+(.+))?$", p, re.S) for p in _parts(code)]
    bare = _parts(code)
    # names stand before types; a part of one word takes the type of the next part that has one
    if not any(m and m[2] and not re.match(r"(?:func|chan|map|struct|interface)\b", p) for m, p in zip(parts, bare)):
        return ", ".join(map(type_name, bare))
    out, kind = [], "unknown"
    for m, p in zip(reversed(parts), reversed(bare)):
        kind = type_name(m[2]) if m and m[2] else kind if m else type_name(p)
        out.append(f"{m[1]} {kind}" if m else kind)
    return ", ".join(reversed(out))


def signature(head: str) -> str:
    """C-12: name, parameters in brackets and results without, of a function's head; the receiver is left out."""
    code = head.strip().removeprefix("func").strip()
    if code.startswith("("):
        code = code[_closing(code, 0) + 1 :].strip()
    name = re.match(r"\w*", code)[0]
    code = code[len(name) :].strip()
    if code.startswith("["):  # type parameters
        code = code[_closing(code, 0) + 1 :].strip()
    end = _closing(code, 0) if code.startswith("(") else 0
    results = code[end + 1 :].strip()
    if results.startswith("(") and _closing(results, 0) == len(results) - 1:
        results = fields(results[1:-1])
    elif results:
        results = type_name(results)
    return " ".join(x for x in (name, f"({fields(code[1:end])})", results) if x)


def calls(code: str) -> list[str]:
    """C-11: names that are called, sorted."""
    return sorted({c for c in re.findall(r"([A-Za-z_][\w.]*)\s*\(", code) if c.split(".")[-1] not in _KEYWORDS})


def types(code: str) -> list[str]:
    """C-11: types of others that are named after a name, a star or a bracket, sorted."""
    return sorted({t for t in re.findall(r"[\s*\]\[(]([A-Za-z_]\w*(?:\.[A-Z]\w*)?)\b(?!\s*\()", code) if t[0].isupper() or "." in t} - _BASIC)


def line_counts(text: str) -> tuple[int, float]:
    """C-13, C-14: lines of code, and comment lines over lines that aren't blank."""
    code = comments = 0
    inside = False
    for line in map(str.strip, text.split("\n")):
        if not line:
            continue
        if inside or line.startswith(("//", "/*")):
            comments += 1
            inside = (inside or line.startswith("/*")) and "*/" not in line
        else:
            code += 1
    return code, comments / (code + comments) if code + comments else 0.0


def complexity(text: str) -> int:
    """C-15: 1 plus the branches: if, for, case, default, and the short-circuit signs."""
    return 1 + len(re.findall(r"\b(?:if|for|case|default)\b|&&|\|\|", blank(text)))


def statement_kind(statement: str) -> str:
    """C-17: what a statement at the top of a function's body is."""
    s = statement.strip()
    if re.match(r"if\b", s):
        return "error_handling" if re.match(r"if\s+err\s*!=", s) or re.match(r"if\s+[\w, ]*\berr\b[\w, ]*:?=", s) else "conditional"
    for kind, pattern in (("loop", r"for\b"), ("switch", r"switch\b"), ("channel_select", r"select\b"), ("defer", r"defer\b"), ("return", r"return\b")):
        if re.match(pattern, s):
            return kind
    first = blank(s).split("\n")[0]
    if re.match(r"[\w.,\s\[\]*]+:=", first):
        return "initialization"
    return "assignment" if re.match(r"[\w.,\s\[\]*()]+[-+*/%&|^]?=(?!=)", first) else "statement"


_SIGNIFICANT = {"error_handling", "conditional", "loop", "switch", "channel_select"}


def logic_blocks(function: Declaration) -> list[tuple[str, int, int, str]]:
    """C-16: (kind, first line, last line, comment) of the body's groups of statements.

    A comment before a statement, and every statement that branches or loops, begins a group.
    """
    lines, code = function.text.split("\n"), blank(function.text).split("\n")
    depths = _depths(blank(function.text))
    opening = next((i for i, d in enumerate(depths[1:], 1) if d), len(code))
    groups: list[list] = []
    comment: list[str] = []
    i = opening
    while i < len(code) - 1:
        bare = lines[i].strip()
        if bare.startswith("//"):
            comment.append(bare)
        elif bare:
            end = i
            while end + 1 < len(code) - 1 and depths[end + 1] > 1:
                end += 1
            kind = statement_kind("\n".join(lines[i : end + 1]))
            if comment or kind in _SIGNIFICANT or not groups or groups[-1][0] in _SIGNIFICANT:
                groups.append([kind, i, end, "\n".join(comment)])
            else:
                groups[-1][2] = end
            comment, i = [], end
        i += 1
    first = function.start
    return [(k, first + a, first + b, c) for k, a, b, c in groups] or [("main_logic", function.start, function.end, "")]


def chunks(source: str, count: Callable[[str], int]) -> list[Declaration]:
    """C-09, C-16: declarations within their token bounds and not nearly all comment, and the logic of long functions."""
    out: list[Declaration] = []
    lines = source.split("\n")
    for d in declarations(source):
        if d.kind == "package" and not d.doc:
            continue
        d.tokens = count(d.text)
        least = LEAST_TYPE if d.kind in ("struct", "interface", "type") else LEAST
        fits = least <= d.tokens <= MOST and line_counts(d.text)[1] <= MOST_COMMENTS
        if fits:
            out.append(d)
        if d.kind in ("function", "method") and (d.end - d.start + 1 >= SPLIT_LINES or complexity(d.text) >= SPLIT_COMPLEXITY):
            for kind, a, b, comment in logic_blocks(d):
                text = "\n".join(lines[a - 1 : b])
                tokens = count(text)
                if LEAST_LOGIC <= tokens <= MOST_LOGIC:
                    out.append(Declaration(f"logic_{kind}", f"{d.name}_{kind}_{a}", a, b, text, d.name, d.signature, comment or None, tokens, 3))
    return out


def file_summary(source: str, language: str, count: Callable[[str], int], most: int = 400) -> str:
    """C-18: language, components by kind, dependencies (external ones first) and the top comment, within ``most`` tokens."""
    from tessera.operators.chunking import trim

    parts = [f"Language: {language}"]
    try:
        found = list(declarations(source)) if language.lower() == "go" else []
    except ParseError:
        found = []
    by_kind: dict[str, list[str]] = {}
    for d in found:
        if d.kind not in ("package", "const", "var") and d.name:
            by_kind.setdefault(d.kind.capitalize(), []).append(d.name)
    if not by_kind:
        names = re.findall(r"^\s*(?:def|class|func|function|interface|type)\s+(\w+)", source, re.M)
        by_kind = {"Component": names} if names else {}
    if by_kind:
        parts += ["", "Components:", *(f"- {k}: {', '.join(by_kind[k])}" for k in sorted(by_kind))]
    split = imports(source)
    if split["external"] or split["standard"]:
        parts += ["", "Dependencies:", *(f"- {p}" for p in split["external"] + split["standard"])]
    top = next((d.doc for d in found if d.kind == "package" and d.doc), None)
    if top is None:
        lines = [x.strip().lstrip("/#*").strip() for x in source.split("\n")[:10] if x.strip().startswith(("//", "#", "/*", "*"))]
        top = "\n".join(lines)
    if top:
        parts += ["", f"Description: {trim(top, 100, count)}"]
    return trim("\n".join(parts), most, count)


_DESCRIBED = "id bigint, kind string, name string, parent string, signature string, start_line int, end_line int, calls string, types string, complexity int, lines_of_code int, error string"


def describe(files: DataFrame) -> DataFrame:
    """C-09, C-11 to C-15 as a table: the declarations of Go files (id, content); a file that can't be parsed gives one row with ``error``."""

    def rows(id_: int, source: str) -> Iterator[tuple]:
        for d in declarations(source):
            yield id_, d.kind, d.name, d.parent, d.signature, d.start, d.end, ",".join(d.calls), ",".join(d.types), complexity(d.text), line_counts(d.text)[0], None

    return _table(files, rows, _DESCRIBED)


def logic(files: DataFrame) -> DataFrame:
    """C-16, C-17 as a table: id, name, kind, start_line, end_line of the groups of statements of every function."""

    def rows(id_: int, source: str) -> Iterator[tuple]:
        for d in declarations(source):
            if d.kind in ("function", "method"):
                for kind, a, b, _ in logic_blocks(d):
                    yield id_, d.name, kind, a, b, None

    return _table(files, rows, "id bigint, name string, kind string, start_line int, end_line int, error string")


def imported(files: DataFrame) -> DataFrame:
    """C-10 as a table: id, path, is_standard of every import."""

    def rows(id_: int, source: str) -> Iterator[tuple]:
        found = imports(source)
        yield from ((id_, p, kind == "standard", None) for kind in found for p in found[kind])

    return _table(files, rows, "id bigint, path string, is_standard boolean, error string")


def summarised(files: DataFrame, count: Callable[[str], int], most: int = 400) -> DataFrame:
    """C-18 as a table: id and summary of files (id, language, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                text = [file_summary(c or "", k or "", count, most) for k, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string())], names=["id", "summary"])

    return files.select("id", "language", "content").mapInArrow(run, "id bigint, summary string")


def _table(files: DataFrame, rows: Callable[[int, str], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows of every file; the last column is the error of a file that can't be parsed."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    names, types_ = zip(*(c.split() for c in schema.split(", ")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                out: list[tuple] = []
                for id_, source in zip(*(c.to_pylist() for c in batch.slice(low, 64).columns)):
                    try:
                        out += list(rows(id_, source or ""))
                    except ParseError as e:
                        out.append((id_, *[None] * (len(names) - 2), str(e)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*out), types_)], names=list(names))

    return files.select("id", "content").mapInArrow(run, schema)
