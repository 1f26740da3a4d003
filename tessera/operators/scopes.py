"""Calls resolved by scope (H-11): the own package or the import table tells whose symbol a name is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.lineage import spread as dealt

#: Over how many tasks the calls of one symbol are spread; each symbol is copied as often.
SPREAD = 16


def packages_of(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package): the package that is the longest suffix of an import path by whole segments; other paths are external and left out.

    A path meets packages by its own suffixes, so rows grow with its segments and not with the packages.
    """
    parts = F.split("path", "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), "/").alias("package"), (-i).alias("length")))
    tails = paths.select("path").dropna().distinct().select("path", F.explode(suffixes).alias("_s")).select("path", "_s.package", "_s.length")
    known = packages.select("package").dropna().distinct()
    return tails.join(known, "package").groupBy("path").agg(F.max_by("package", "length").alias("package"))


def import_tables(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(scope, qualifier, package) of imports (scope, alias, path).

    Without an alias the path's last segment names the import.  Where a scope gives one name to several packages, the first in order is taken.
    """
    named = imports.select("scope", F.coalesce(F.nullif("alias", F.lit("")), F.element_at(F.split("path", "/"), -1)).alias("qualifier"), "path")
    known = named.join(packages_of(imports, symbols), "path").select("scope", "qualifier", "package")
    return dealt(known, "scope", "qualifier").groupBy("scope", "qualifier").agg(F.min("package").alias("package"))


def resolved(calls: DataFrame, imports: DataFrame, symbols: DataFrame, spread: int = SPREAD) -> DataFrame:
    """(from_id, dep_type, package, symbol, to_id, candidates): every different call once; to_id NULL and candidates 0 where no symbol answers.

    calls: (from_id, scope, package, qualifier, symbol, dep_type), where a NULL or empty qualifier means the caller's own package;
    imports: (scope, alias, path); symbols: (id, package, name).
    A call has one answer: of several symbols of one name in a package the smallest id, and ``candidates`` tells how many there are.
    So the result is linear in the calls.  Calls are made distinct before they meet symbols, and a symbol that a large
    share of them names is copied ``spread`` times and meets as many parts of them.

    Names are long and packed well in a shuffle, so parts that are put together by their packed bytes are many times as large
    in memory: rows are dealt to a number of tasks instead, and a task's memory is its share of the calls.
    """
    rows = calls.select("from_id", "scope", "package", F.nullif("qualifier", F.lit("")).alias("qualifier"), "symbol", "dep_type")
    own = rows.filter("qualifier is null").select("from_id", "dep_type", "package", "symbol")
    table = import_tables(imports, symbols)
    other = dealt(rows.filter("qualifier is not null").drop("package"), "scope", "qualifier").join(table, ["scope", "qualifier"], "left").select("from_id", "dep_type", "package", "symbol")
    asked = dealt(own.unionAll(other), "from_id", "symbol").distinct().withColumn("_salt", F.pmod(F.xxhash64("from_id"), F.lit(spread)).cast("int"))
    answers = symbols.groupBy("package", F.col("name").alias("symbol")).agg(F.min("id").alias("to_id"), F.count("*").alias("candidates"))
    copies = answers.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(spread)])))
    met = dealt(asked, "package", "symbol", "_salt").join(dealt(copies, "package", "symbol", "_salt"), ["package", "symbol", "_salt"], "left")
    return met.select("from_id", "dep_type", "package", "symbol", "to_id", F.coalesce("candidates", F.lit(0)).alias("candidates"))


def edges(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """H-11: (from_id, to_id, dep_type, symbol) of the calls that a symbol answers, but for those that a symbol makes of itself."""
    found = resolved(calls, imports, symbols).filter("to_id is not null and from_id <> to_id")
    return dealt(found.select("from_id", "to_id", "dep_type", "symbol"), "from_id", "to_id").distinct()
