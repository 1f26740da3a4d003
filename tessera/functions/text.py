"""Text, path and code expressions (C-03, C-08, C-13, C-14, C-15, C-19 to C-22, D-07, S-10, R-07)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line endings that ask for what follows.
INCOMPLETE_ENDINGS = (":", "、", ",")
#: Words after which something is announced.
ANNOUNCING = ("以下の", "次の", "以下に", "次に", "following", "next", "below")
#: Relative parts of a path that decide its domain; the first domain that matches wins.
DOMAIN_PATTERNS = (
    ("tests", r"(_test\.[^/]*$)|(^|/)(test|tests|__tests__|spec)/"),
    ("ops", r"((^|/)(scripts|ops)/)|(\.(sh|bash)$)"),
    ("architecture", r"((^|/)(docs|doc)/)|(\.(md|rst|adoc)$)"),
    ("infra", r"((^|/)(terraform|k8s)/)|((^|/)Dockerfile)|((^|/)docker-compose)|(\.(yml|yaml|tf)$)"),
)
#: Query words that tell an intent; the first intent that matches wins.
INTENT_PATTERNS = (
    ("operations", r"\b(deploy|deployment|rollback|incident|restart|runbook|monitor)\w*"),
    ("api_spec", r"\b(api|endpoint|request|response|interface|schema)\w*"),
    ("design", r"\b(why|design|architecture|decision|trade-?off)\w*"),
    ("code_reading", r"\b(function|class|method|implement|where|how)\w*"),
)
#: (vector weight, keyword weight) by intent.
INTENT_WEIGHTS = {"code_reading": (0.7, 0.3), "api_spec": (0.6, 0.4), "design": (0.8, 0.2), "operations": (0.5, 0.5), "default": (0.7, 0.3)}


def est_tokens(text: Column) -> Column:
    """The offline token count: a quarter of the characters, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_key(product: Column, source: Column, path: Column, start: Column, end: Column, ordinal: Column, version: Column) -> Column:
    return F.format_string("%s/%s/%s#L%d-L%d:%d@%s", product, source, path, start, end, ordinal, version)


def merkle(hashes: Column) -> Column:
    """Hash of an aggregated list of hashes, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(hashes), ":"), 256)


def lock_id(*parts: Column) -> Column:
    """D-11: the lock of a source and ref: the first 8 bytes of their SHA-256, big-endian and signed."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, -10).cast("bigint")


def dirname(path: Column) -> Column:
    """'' for the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def depth(path: Column) -> Column:
    """0 for the root, otherwise separators plus one."""
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).cast("int")


def ancestors(path: Column) -> Column:
    """All directories above a file path, from the root ('') down."""
    parts = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/")))


def classify_domain(path: Column) -> Column:
    out = F.lit("code")
    for name, pattern in reversed(DOMAIN_PATTERNS):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def classify_intent(query: Column) -> Column:
    out = F.lit("default")
    for name, pattern in reversed(INTENT_PATTERNS):
        out = F.when(F.lower(query).rlike(pattern), name).otherwise(out)
    return out


def incomplete_ending(text: Column) -> Column:
    """Whether the last line that isn't blank leaves something open (C-03): by its end, or by an announcing word before a mark."""
    last = F.substring_index(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), "\n", -1)
    words = "|".join(ANNOUNCING)
    return last.rlike(rf"(?:{'|'.join((*INCOMPLETE_ENDINGS, *ANNOUNCING))})\z") | last.rlike(rf"(?:{words})[:、]")


def trimmed(text: Column, most: int) -> Column:
    """The longest prefix of at most ``most`` estimated tokens (C-08)."""
    return F.substring(text, 1, 4 * most)


def unit_lines(text: Column, patterns: Sequence[str]) -> Column:
    """The numbers, from 1, of the lines that begin a unit of source code (C-04)."""
    lines = F.split(text, "\n")
    marked = F.transform(lines, lambda x, i: F.when(x.rlike("|".join(f"(?:{p})" for p in patterns)), i + 1))
    return F.filter(marked, lambda x: x.isNotNull())


def source_name(url: Column) -> Column:
    """host/path of a repository URL without user, port and '.git' (S-10)."""
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-z+]+://", ""), "^[^@/]+@", "")
    return F.regexp_replace(F.regexp_replace(bare, "^([^/:]+):(?:[0-9]+/)?", "$1/"), r"\.git/?$", "")


def code_lines(text: Column) -> Column:
    """struct(loc, comments, nonblank) by one fold over the lines (C-13, C-14)."""
    start = F.struct(F.lit(False).alias("block"), F.lit(0).alias("loc"), F.lit(0).alias("comments"), F.lit(0).alias("nonblank"))

    def step(s: Column, raw: Column) -> Column:
        line = F.trim(raw)
        blank = line == ""
        opens = ~s["block"] & line.startswith("/*")
        inside = s["block"] | opens
        comment = inside | line.startswith("//")
        closes = inside & line.contains("*/")
        return F.struct(
            F.when(blank, s["block"]).otherwise(inside & ~closes).alias("block"),
            (s["loc"] + F.when(~blank & ~comment, 1).otherwise(0)).alias("loc"),
            (s["comments"] + F.when(~blank & comment, 1).otherwise(0)).alias("comments"),
            (s["nonblank"] + F.when(blank, 0).otherwise(1)).alias("nonblank"),
        )

    return F.aggregate(F.split(text, "\n"), start, step)


def comment_ratio(lines: Column) -> Column:
    return F.coalesce(F.try_divide(lines["comments"], lines["nonblank"]), F.lit(0.0))


def branch_count(text: Column) -> Column:
    """Cyclomatic complexity by its keywords: 1 plus if, for, case, default and the short-circuit signs (C-15)."""
    # The look at the next character passes over most of a text.
    return (1 + F.regexp_count(text, F.lit(r"(?=[ifcd&|])(?:\b(?:if|for|case|default)\b|&&|\|\|)"))).cast("int")
