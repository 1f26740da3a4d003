"""Line-addressed chunkers and their table form (C-01, C-02, C-04 to C-08, C-20, U-01, U-03).

The chunkers are sequential, so they run a document at a time inside ``mapInPandas``.  A chunk is a range of
lines; with the additive token estimate the size of any range comes from two prefix sums, so a document costs
one pass.  A real tokenizer can be plugged in as ``count``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Content types that are chunked as source code.
SOURCE_TYPES = (
    "text/x-go", "text/javascript", "text/x-typescript", "text/x-python", "text/x-java", "text/x-c", "text/x-c++", "text/x-csharp",
    "text/x-ruby", "text/x-php", "text/x-rust", "text/x-swift", "text/x-kotlin", "text/x-scala", "text/x-shellscript",
)
#: Lines that begin a unit of source code.  The second one also matches calls and control lines.
BOUNDARIES = (
    r"^\s*(func|function|def|class|interface|struct|enum|type)\s+\w+",
    r"^\s*(public|private|protected|static)?\s*(async)?\s*\w+\s*\(",
)
_BOUNDARY = re.compile("|".join(f"(?:{b})" for b in BOUNDARIES))


@dataclass(frozen=True)
class Limits:
    """Tokens of a chunk at most, at least, aimed at, and carried over."""

    most: int = 1600
    least: int = 100
    target: int = 800
    overlap: int = 200
    merge_small: bool = False


@dataclass(frozen=True)
class Chunk:
    start: int  # first line, from 1
    end: int
    content: str
    tokens: int


def estimate(text: str) -> int:
    return -(-len(text) // 4)


class Lines:
    """A document's lines and the token counts of ranges of them."""

    def __init__(self, text: str, count: Callable[[str], int] | None = None):
        self.lines = text.split("\n")
        self.count = count
        self.before = [0]
        for line in self.lines:
            self.before.append(self.before[-1] + len(line) + 1)

    def text(self, a: int, b: int) -> str:
        return "\n".join(self.lines[a:b])

    def tokens(self, a: int, b: int) -> int:
        if self.count:
            return self.count(self.text(a, b))
        return -(-max(0, self.before[b] - self.before[a] - 1) // 4)

    def carried(self, a: int, b: int, overlap: int) -> int:
        """Lines at the end of [a, b) that hold ``overlap`` tokens, all of them if they hold fewer."""
        total = 0
        for i in range(b - 1, a - 1, -1):
            total += self.tokens(i, i + 1)
            if total >= overlap:
                return b - i
        return b - a


class _Out:
    def __init__(self, lines: Lines, limits: Limits):
        self.lines, self.limits, self.chunks = lines, limits, []

    def add(self, a: int, b: int) -> None:
        tokens = self.lines.tokens(a, b)
        if tokens >= self.limits.least:
            self.chunks.append(Chunk(a + 1, b, self.lines.text(a, b), tokens))
        elif self.limits.merge_small and self.chunks and self.chunks[-1].end == a:
            last = self.chunks.pop()
            start = last.start - 1
            self.chunks.append(Chunk(last.start, b, self.lines.text(start, b), self.lines.tokens(start, b)))


def _by_units(text: str, limits: Limits, count: Callable[[str], int] | None, begins: Iterator[tuple[bool, bool]]) -> list[Chunk]:
    """Cut before each line that begins a unit; cut an overlong unit where cutting is allowed, and carry lines over.

    begins: for each line whether it begins a unit, and whether an overlong chunk may end after it.
    """
    lines = Lines(text, count)
    out, at = _Out(lines, limits), 0
    for i, (unit, may_cut) in enumerate(begins):
        if unit and i > at:
            out.add(at, i)
            at = i
        elif may_cut and lines.tokens(at, i + 1) > limits.most:
            cut = i + 1 - lines.carried(at, i + 1, limits.overlap)
            if cut > at:
                out.add(at, cut)
                at = cut
    out.add(at, len(lines.lines))
    return out.chunks


def markdown(text: str, limits: Limits = Limits(), count: Callable[[str], int] | None = None) -> list[Chunk]:
    """C-02: by headings; never inside a fence or a table.  A line with a bar is a table's, heading sign or not."""

    def begins() -> Iterator[tuple[bool, bool]]:
        fenced = table = False
        for line in text.split("\n"):
            bare = line.strip()
            if bare.startswith("```"):
                fenced = not fenced
            if bare.startswith("|") or ("|" in line and not fenced):
                table = True
            elif "|" not in line:
                table = False
            free = not fenced and not table
            yield free and bare.startswith("#"), free

    return _by_units(text, limits, count, begins())


def source_code(text: str, limits: Limits = Limits(), count: Callable[[str], int] | None = None) -> list[Chunk]:
    """C-04: by the lines that begin a unit."""
    return _by_units(text, limits, count, ((bool(_BOUNDARY.match(line)), True) for line in text.split("\n")))


def plain(text: str, limits: Limits = Limits(), count: Callable[[str], int] | None = None) -> list[Chunk]:
    """C-05: a chunk ends as soon as it holds the target; the carried lines begin the next one, at the end too."""
    lines = Lines(text, count)
    out, at, n = _Out(lines, limits), 0, len(lines.lines)
    for i in range(n):
        if lines.tokens(at, i + 1) >= limits.target:
            out.add(at, i + 1)
            carried = lines.carried(at, i + 1, limits.overlap)
            at = i + 1 - carried if 0 < carried < i + 1 - at else i + 1
    if at < n:
        out.add(at, n)
    return out.chunks


def trim(text: str, most: int, count: Callable[[str], int] = estimate) -> str:
    """C-08: the longest prefix of at most ``most`` tokens."""
    if count(text) <= most:
        return text
    low, high = 0, len(text)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if count(text[:middle]) <= most else (low, middle - 1)
    return text[:low]


def strategy(content_type: Column) -> Column:
    """C-01."""
    return F.when(content_type == "text/x-go", "go").when(content_type == "text/markdown", "markdown").when(content_type.isin(*SOURCE_TYPES), "source").otherwise("plain")


CHUNK_SCHEMA = "file_id bigint, ordinal int, start_line int, end_line int, content string, token_count int, chunk_type string, chunk_name string, parent_name string, level int, error string"


def chunk_files(files: DataFrame, limits: Limits = Limits(), count: Callable[[str], int] | None = None, carried: Sequence[str] = ()) -> DataFrame:
    """C-01, D-02: the chunks of files (id, content_type, content); a file that can't be parsed gives one row with ``error``.

    Each chunk gets its file's ``carried`` columns, so that they need no join.
    """
    from tessera.operators import gocode

    by_name = {"markdown": markdown, "source": source_code, "plain": plain}

    def rows(file_id: int, how: str, text: str) -> Iterator[tuple]:
        if how == "go":
            for n, c in enumerate(gocode.chunks(text, count or estimate)):
                yield file_id, n, c.start, c.end, c.text, c.tokens, c.kind, c.name, c.parent, c.level, None
        else:
            for n, c in enumerate(by_name[how](text, limits, count)):
                yield file_id, n, c.start, c.end, c.content, c.tokens, None, None, None, 2, None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
        for frame in frames:
            out = []
            for file_id, how, text, *more in zip(frame["id"], frame["how"], frame["content"], *(frame[c] for c in carried)):
                try:
                    out += [(*row, *more) for row in rows(file_id, how, text or "")]
                except gocode.ParseError as e:
                    out.append((file_id, None, None, None, None, None, None, None, None, None, str(e), *more))
            table = pd.DataFrame(out, columns=[*names, *carried]).astype(object)
            yield table.where(table.notna(), None)

    rows_ = files.select("id", strategy(F.col("content_type")).alias("how"), "content", *carried)
    schema = ", ".join([CHUNK_SCHEMA, *(f"`{c}` {rows_.schema[c].dataType.simpleString()}" for c in carried)])
    return rows_.mapInPandas(run, schema)


def sections(docs: DataFrame) -> DataFrame:
    """C-02 without the overflow, natively: id, section, start_line, end_line of Markdown texts (id, text).

    Fence parity and sections are running sums inside a document, whose lines one document bounds.
    """
    lines = F.split("text", "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    start = F.struct(F.lit(False).alias("fenced"), F.lit(False).alias("table"), F.lit(0).alias("line"), F.array().cast("array<int>").alias("heads"))

    def step(s: Column, x: Column) -> Column:
        fenced = s["fenced"] != x.startswith("```")
        bar = x.startswith("|") | (x.contains("|") & ~fenced)
        table = bar | (s["table"] & x.contains("|"))
        line = s["line"] + 1
        head = x.startswith("#") & ~fenced & ~table
        return F.struct(fenced.alias("fenced"), table.alias("table"), line.alias("line"), F.when(head & (line > 1), F.concat(s["heads"], F.array(line))).otherwise(s["heads"]).alias("heads"))

    heads = F.concat(F.array(F.lit(1)), F.aggregate(bare, start, step, lambda s: s["heads"]))
    rows = docs.select("id", F.size(lines).alias("_n"), heads.alias("_h"))
    rows = rows.select("id", "_n", "_h", F.posexplode("_h").alias("section", "start_line"))
    return rows.select("id", "section", "start_line", F.coalesce(F.get("_h", F.col("section") + 1) - 1, F.col("_n")).alias("end_line"))
