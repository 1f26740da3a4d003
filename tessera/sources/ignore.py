"""Ignore patterns as one regular expression (S-12)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that are ignored by default; they come last, so they win over a project's negations.
DEFAULT_PATTERNS = (
    ".git", ".gitignore", ".gitattributes", ".gitmodules",
    "node_modules", "vendor", "dist", "build", "target", "out", "bin", "obj", ".next", ".nuxt", ".vuepress/dist",
    ".vscode", ".idea", ".DS_Store", "*.swp", "*.swo", "*~",
    "*.log", "logs",
    "*.tmp", "*.temp", "tmp", "temp",
    ".env", ".env.local", ".env.*.local", "*.pem", "*.key", "*.crt", "*.p12",
    "*.exe", "*.dll", "*.so", "*.dylib", "*.a", "*.o", "*.jar", "*.war", "*.ear", "*.zip", "*.tar", "*.gz", "*.bz2", "*.7z", "*.rar",
    "*.png", "*.jpg", "*.jpeg", "*.gif", "*.bmp", "*.ico", "*.svg", "*.webp", "*.mp4", "*.avi", "*.mov", "*.wmv", "*.flv", "*.mp3", "*.wav", "*.ogg", "*.flac",
    "*.ttf", "*.otf", "*.woff", "*.woff2", "*.eot",
    "*.db", "*.sqlite", "*.sqlite3",
    "coverage", ".coverage", "*.cover", "*.lcov",
    ".cache", "*.cache", "__pycache__", "*.pyc", ".pytest_cache",
    ".docusaurus", "docs/.vuepress/.cache", "docs/.vuepress/dist",
)


def pattern_regex(pattern: str) -> str:
    """A gitignore pattern as a regular expression over a path from the root; what lies under a match is matched too."""
    body = pattern.rstrip("/")
    anchored = "/" in body
    body = body.removeprefix("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inside = body[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]", end + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if pattern.endswith('/') else '(?:/.*)?'}$"


def ignored(path: Column, patterns: Sequence[str] = (), defaults: bool = True) -> Column:
    """Whether the last pattern that matches says so; runs of patterns without a negation become one alternation."""
    rules = [p.strip() for p in patterns if p.strip() and not p.lstrip().startswith("#")] + list(DEFAULT_PATTERNS if defaults else ())
    out, run, sign = F.lit(False), [], True
    for rule in [*rules, None]:
        negated = rule is not None and rule.startswith("!")
        if run and (rule is None or negated == sign):
            out = F.when(path.rlike("|".join(f"(?:{r})" for r in run)), F.lit(sign)).otherwise(out)
            run = []
        if rule is not None:
            sign = not negated
            run.append(pattern_regex(rule.removeprefix("!")))
    return out
