"""Content types and languages by file name, then by content (S-13, S-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language, content type and endings.
LANGUAGES = (
    ("Go", "text/x-go", ("go",)), ("JavaScript", "text/javascript", ("js", "mjs", "jsx")), ("TypeScript", "text/x-typescript", ("ts", "tsx")),
    ("Python", "text/x-python", ("py",)), ("Java", "text/x-java", ("java",)), ("C", "text/x-c", ("c", "h")), ("C++", "text/x-c++", ("cpp", "cc", "hpp")),
    ("C#", "text/x-csharp", ("cs",)), ("Ruby", "text/x-ruby", ("rb",)), ("PHP", "text/x-php", ("php",)), ("Rust", "text/x-rust", ("rs",)),
    ("Swift", "text/x-swift", ("swift",)), ("Kotlin", "text/x-kotlin", ("kt", "kts")), ("Scala", "text/x-scala", ("scala",)),
    ("Shell", "text/x-shellscript", ("sh", "bash", "zsh")), ("Markdown", "text/markdown", ("md", "markdown")), ("HTML", "text/html", ("html", "htm")),
    ("CSS", "text/css", ("css",)), ("SCSS", "text/x-scss", ("scss",)), ("SASS", "text/x-sass", ("sass",)), ("Less", "text/x-less", ("less",)),
    ("JSON", "application/json", ("json",)), ("YAML", "text/x-yaml", ("yml", "yaml")), ("XML", "text/xml", ("xml",)), ("SQL", "text/x-sql", ("sql",)),
    ("Protocol Buffer", "text/x-protobuf", ("proto",)), ("Thrift", "text/x-thrift", ("thrift",)), ("GraphQL", "application/graphql", ("graphql", "gql")),
    ("Terraform", "text/x-terraform", ("tf",)), ("HCL", "text/x-hcl", ("hcl",)),
)
#: Whole names.
NAMES = {"dockerfile": ("Dockerfile", "text/x-dockerfile"), "makefile": ("Makefile", "text/x-makefile")}
SOURCE = frozenset(x[0] for x in LANGUAGES[:15])
_BY_ENDING = {e: (name, mime) for name, mime, endings in LANGUAGES for e in endings}


def _lookup(path: Column, which: int) -> Column:
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    ending = F.when(name.contains("."), F.element_at(F.split(name, r"\."), -1))
    endings = F.create_map(*[F.lit(x) for e, v in _BY_ENDING.items() for x in (e, v[which])])
    names = F.create_map(*[F.lit(x) for n, v in NAMES.items() for x in (n, v[which])])
    return F.coalesce(F.try_element_at(names, name), F.try_element_at(endings, ending))


#: The interpreters of scripts, as their first line names them, and their languages.
INTERPRETERS = (("python", "Python"), ("bash", "Shell"), ("dash", "Shell"), ("zsh", "Shell"), ("sh", "Shell"), ("node", "JavaScript"), ("ruby", "Ruby"), ("php", "PHP"))
#: First bytes in hex, and content types.
SIGNATURES = (
    ("25504446", "application/pdf"), ("89504E470D0A1A0A", "image/png"), ("FFD8FF", "image/jpeg"), ("47494638", "image/gif"), ("504B0304", "application/zip"),
    ("1F8B08", "application/x-gzip"), ("7F454C46", "application/octet-stream"), ("FEFF", "text/plain"), ("FFFE", "text/plain"), ("EFBBBF", "text/plain"),
)
_HEAD = 512
_CPP = r"(?m)^\s*(?:template\s*<|namespace\s+\w|using\s+(?:namespace|std)|class\s+\w+[^;]*\{|#include\s*<(?:iostream|string|vector|map|memory)>)"


def _script(content: Column) -> Column:
    """The language of a script that names its interpreter."""
    line = F.regexp_extract(F.substring(content.cast("binary"), 1, _HEAD).cast("string"), r"^#!\s*(\S+(?:[ \t]+(?:-\S+[ \t]+)*[\w.]+)?)", 1)
    names = F.split(F.regexp_replace(line, r"\S*/", ""), r"[ \t]+")
    name = F.regexp_replace(F.when(names[0] == "env", F.element_at(names, -1)).otherwise(names[0]), r"[\d.]+$", "")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in INTERPRETERS for x in pair]), name)


def language(path: Column, content: Column | None = None) -> Column:
    """By name; with the content also by a script's first line, and C++ in a header that only it can hold."""
    named = _lookup(path, 0)
    if content is None:
        return named
    header = path.rlike(r"(?i)\.h$") & content.cast("string").rlike(_CPP)
    return F.when(header, "C++").otherwise(F.coalesce(named, _script(content)))


def content_type(path: Column, content: Column | None = None) -> Column:
    """By name, or the language that the content tells; else by the first bytes: signatures, markup, a NUL; else plain text."""
    if content is None:
        return F.coalesce(_lookup(path, 1), F.lit("text/plain"))
    mime = F.create_map(*[F.lit(x) for name, kind, _ in LANGUAGES for x in (name, kind)])
    head = F.substring(content.cast("binary"), 1, _HEAD)
    markup, first = F.lower(F.ltrim(head.cast("string"), F.lit(" \t\n\x0c\r"))), F.hex(head)
    sniffed = F.when(markup.startswith("<!doctype html") | markup.startswith("<html"), "text/html").when(markup.startswith("<?xml"), "text/xml")
    for signature, kind in SIGNATURES:
        sniffed = sniffed.when(first.startswith(signature), kind)
    sniffed = sniffed.when(first.rlike("^(..)*00"), "application/octet-stream").otherwise("text/plain")
    return F.coalesce(F.try_element_at(mime, language(path, content)), _lookup(path, 1), sniffed)


def registry(spark: SparkSession) -> DataFrame:
    """S-14: language, content_type, ending, is_source, has_parser; a small dimension to broadcast."""
    rows = [(name, mime, e, name in SOURCE, name == "Go") for name, mime, endings in LANGUAGES for e in endings]
    return spark.createDataFrame(rows, "language string, content_type string, ending string, is_source boolean, has_parser boolean")
