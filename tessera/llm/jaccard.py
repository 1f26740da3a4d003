"""N-gram Jaccard join: grouped prefix join, with exact connected components.

A text's set holds the hashes of its word n-grams (64 bits; of two texts' sets, two different n-grams share one
with odds of about 1e-9).  Sets are ordered rarest n-gram first, by frequency classes from a sketch of fixed
size (``SKETCH_BITS``) over all texts; any one order is right, this one keeps frequent n-grams out of the
prefixes.  Two sets that are similar enough share an n-gram in their prefixes.

1. Texts with equal sets are one *class*; classes with equal prefixes and size are one *group*.
2. Groups meet on the n-grams of their prefixes.  Of the groups that meet on one, the one that holds it
   earliest leads, and the others are paired with it alone; pairs pass the size and position filters, are
   expanded to classes, and the classes' sets are compared.
3. Links so found give labels.  Where sets with different labels still meet, labels are paired first (by the
   least position and the range of sizes), and the members of those that pass are compared as well.

Step 3 leaves no candidate out, and pairs of one label need no comparison: the components are those of all
links, without pairs growing with the square of a group of near copies.

Defined results: a null, empty or white text has an empty set and is linked with nothing; repeated rows and
ties are in one class; null ids never name a component unless it has no other; a very long text is one set like others (a task holds
some 20 bytes for each of its bytes); an empty table gives no rows; other columns are kept (``keep_one``) or left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.bitmap import bitmap, holds
from tessera.llm.components import components
from tessera.llm.store import discard, materialise
from tessera.llm.textblocks import blocks, shingle_hashes, word_hashes

SKETCH_BITS = 20
_PART = 1 << 10


def frequency_classes(docs: DataFrame, k: int) -> np.ndarray:
    """For each of 2**SKETCH_BITS hash buckets, twice the logarithm of its n-grams over all texts (one byte each).

    A task's counts leave it in parts of 4 KB; parts are summed as they stream in, so a task holds one sketch at most.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(1 << SKETCH_BITS, np.uint32), [], 0
        for batch in batches:
            for _, _, data, offsets in blocks(batch.column(0)):
                hashes, _, _, first = word_hashes(data, offsets)
                held.append((shingle_hashes(hashes, first, k)[0] >> np.uint64(64 - SKETCH_BITS)).astype(np.int32))
                size += len(held[-1])
                if size > 1_000_000:
                    np.add.at(total, np.concatenate(held), 1)
                    held, size = [], 0
        for grams in held:
            np.add.at(total, grams, 1)
        total = total.reshape(-1, _PART)
        some = np.flatnonzero(total.any(1))
        for low in range(0, len(some), 64):
            parts = some[low : low + 64]
            yield pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([total[p].tobytes() for p in parts], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total.setdefault(part, np.zeros(_PART, np.uint64))[:] += np.frombuffer(counts.as_buffer(), np.uint32)
        for part, counts in total.items():
            classes = (2 * np.log2(counts + 1.0)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([classes.tobytes()], pa.binary())], names=["part", "classes"])

    parts = docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, classes binary")
    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for row in parts.collect():  # a table of fixed size
        out[row["part"] * _PART : (row["part"] + 1) * _PART] = np.frombuffer(row["classes"], np.uint8)
    return out


def _set_keys(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    return (classes[(hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (hashes & np.uint64((1 << 56) - 1))


def _sets(column: pa.Array, k: int, classes: np.ndarray) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, row after the last, each text's set, rarest first) by blocks: what leaves a task at once is bounded."""
    for low, high, data, offsets in blocks(column):
        hashes, _, _, first = word_hashes(data, offsets)
        grams, at = shingle_hashes(hashes, first, k)
        keys, out = _set_keys(grams, classes), []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            own = np.sort(keys[a:b])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if b - a > 1 else own)
        yield low, high, out


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays).view(np.int64)))


def _class_id(own: np.ndarray, size: int = 0) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16, salt=size.to_bytes(16, "little")).digest()


def signatures(docs: DataFrame, k: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """doc_id, h (hash of the text), n (set size), cid and gid (equal for equal sets, and for equal prefixes and sizes), prefix (n-grams one of which a similar set must share)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, sets in _sets(batch.column(1), k, classes):
                n = np.array([len(own) for own in sets], np.int64)
                prefixes = [own[: size + num * size // -den + 1 if size else 0] for own, size in zip(sets, n.tolist())]
                cid, gid = pa.array([_class_id(own) for own in sets], pa.binary()), pa.array([_class_id(p, size) for p, size in zip(prefixes, n.tolist())], pa.binary())
                columns = [batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low), pa.array(n), cid, gid, _lists(prefixes)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n", "cid", "gid", "prefix"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    return rows.mapInArrow(run, "doc_id bigint, h bigint, n bigint, cid binary, gid binary, prefix array<bigint>")


def _wanted_sets(docs: DataFrame, wanted: DataFrame, k: int, classes: np.ndarray) -> DataFrame:
    """(node, grams) of the wanted classes (node, cid).  A bitmap of fixed size spares texts that can't be wanted."""
    seen = bitmap(wanted, F.conv(F.hex(F.substring("cid", 1, 7)), 16, 10).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()  # copies of a text within a task leave it once
        for batch in batches:
            for _, _, sets in _sets(batch.column(0), k, classes):
                ids = [_class_id(own) for own in sets]
                may = holds(seen, np.array([int.from_bytes(c[:7], "big") for c in ids], np.uint64))
                found = [(ids[i], sets[i]) for i in np.flatnonzero(may).tolist() if not (ids[i] in sent or sent.add(ids[i]))]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.binary()), _lists([own for _, own in found])], names=["cid", "grams"])

    found = docs.select("text").mapInArrow(run, "cid binary, grams array<bigint>").groupBy("cid").agg(F.first("grams").alias("grams"))
    return wanted.join(found, "cid").select("node", "grams")


def _near(at_a: Column, at_b: Column, num: int, den: int) -> Column:
    """Whether sets whose first common n-gram stands at these places can be similar enough."""
    na, nb = _size(at_a), _size(at_b)
    common = F.least(na - _pos(at_a), nb - _pos(at_b))
    return den * common >= num * (na + nb - common)


# A place is one number, position * 2**32 + size of the set, so that tokens stay narrow and sort by position.
def _pos(at: Column) -> Column:
    return F.shiftright(at, 32)


def _size(at: Column) -> Column:
    return at.bitwiseAND(0xFFFFFFFF)


def _possible(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose prefixes leave room for similarity.

    What one prefix holds up to the other's last n-gram, and the other doesn't, is not in the other set at all.
    """
    side = nodes.select("node", "n", "prefix")
    a, b = (side.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}")) for x in "uv")
    both = pairs.join(a, "u").join(b, "v")

    def missing(mine: str, other: str) -> Column:
        last = F.element_at(other, -1)
        return F.size(F.filter(F.array_except(mine, other), lambda x: x <= last))

    common = F.least(F.col("nu") - missing("pu", "pv"), F.col("nv") - missing("pv", "pu"))
    return both.filter(den * common >= num * (F.col("nu") + F.col("nv") - common)).select("u", "v")


def _linked(docs: DataFrame, pairs: DataFrame, nodes: DataFrame, k: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """The pairs (u, v) of classes whose sets are similar enough."""
    pairs = materialise(_possible(pairs, nodes, num, den), compact=True)
    wanted = pairs.select(F.col("u").alias("node")).unionAll(pairs.select(F.col("v").alias("node"))).distinct().join(nodes.select("node", "cid"), "node")
    sets = materialise(_wanted_sets(docs, wanted, k, classes), compact=True)
    a, b = sets.select(F.col("node").alias("u"), F.col("grams").alias("a")), sets.select(F.col("node").alias("v"), F.col("grams").alias("b"))
    both = pairs.join(a, "u").join(b, "v").select("u", "v", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("both"))
    links = materialise(both.filter(den * F.col("both") >= num * (F.col("na") + F.col("nb") - F.col("both"))).select("u", "v"), compact=True)
    discard(sets, pairs)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, h (xxhash64 of the text), n_shingles, component_id (the smallest doc_id reachable over links of similarity num/den or more)."""
    frequencies = frequency_classes(docs, k)
    rows = materialise(signatures(docs, k, num, den, frequencies))
    firsts = [F.first(c).alias(c) for c in ("n", "gid", "prefix")]
    nodes = materialise(rows.filter("n > 0").groupBy("cid").agg(F.min("doc_id").alias("least"), *firsts).withColumn("node", F.monotonically_increasing_id()), compact=True)
    # Nearly every group is one class, so the classes under another's name are the short list.
    several = nodes.groupBy("gid").agg(F.min("node").alias("g"), F.count("*").alias("size")).filter("size > 1")
    under = materialise(nodes.select("node", "gid").join(several, "gid").filter("node <> g").select("node", "g"), compact=True)
    tokens = nodes.join(under, "node", "left_anti").select(F.col("node").alias("g"), "n", F.posexplode("prefix").alias("pos", "key"))
    tokens = tokens.select("key", "g", (F.shiftleft(F.col("pos").cast("bigint"), 32) + F.col("n")).alias("at"))
    leaders = tokens.groupBy("key").agg(F.min(F.struct("at", "g")).alias("lead"), F.count("*").alias("met"))
    leaders = leaders.filter("met > 1").select("key", F.col("lead.at").alias("lead_at"), F.col("lead.g").alias("lead_g"))
    meetings = materialise(tokens.join(leaders, "key"), compact=True)

    led = meetings.filter(F.col("g") != F.col("lead_g")).filter(_near(F.col("at"), F.col("lead_at"), num, den))
    led = led.select(F.col("lead_g").alias("u"), F.col("g").alias("v")).distinct()
    first = materialise(_members(_members(led, under, "u"), under, "v").unionAll(under.select(F.col("g").alias("u"), F.col("node").alias("v"))), compact=True)
    links = _linked(docs, first, nodes, k, num, den, frequencies)
    labels = materialise(components(links), compact=True)

    # Where different labels still meet.  Groups of several classes meet with themselves on their first n-gram.
    inside = nodes.join(under.select(F.col("g").alias("node")).distinct(), "node", "left_semi").select(F.get("prefix", F.lit(0)).alias("key"), F.col("node").alias("g"), F.col("n").alias("at"))
    labelled = _members(meetings.select("key", "g", "at").unionAll(inside).withColumnRenamed("g", "node"), under, "node")
    labelled = materialise(labelled.join(labels, "node", "left").select("key", "node", "at", F.coalesce("component", "node").alias("label")), compact=True)
    spans = labelled.groupBy("key", "label").agg(F.min(_pos(F.col("at"))).alias("pos"), F.min(_size(F.col("at"))).alias("low"), F.max(_size(F.col("at"))).alias("high"))
    mixed = spans.groupBy("key").agg(F.count("*").alias("labels")).filter("labels > 1").select("key")
    spans = spans.join(mixed, "key")
    a, b = (spans.select("key", *(F.col(c).alias(c + x) for c in ("label", "pos", "low", "high"))) for x in "ab")
    common = F.least(F.col("higha") - F.col("posa"), F.col("highb") - F.col("posb"))
    apart = a.join(b, "key").filter((F.col("labela") < F.col("labelb")) & ((den + num) * common >= num * (F.col("lowa") + F.col("lowb"))))
    apart = apart.select("key", "labela", "labelb")
    left, right = (labelled.select("key", *(F.col(c).alias(c + x) for c in ("label", "node", "at"))) for x in "ab")
    second = apart.join(left, ["key", "labela"]).join(right, ["key", "labelb"]).filter(_near(F.col("ata"), F.col("atb"), num, den))
    second = second.select(F.least("nodea", "nodeb").alias("u"), F.greatest("nodea", "nodeb").alias("v")).distinct()
    done = first.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    second = materialise(second.join(done, ["u", "v"], "left_anti"), compact=True)
    if second.count():
        more = _linked(docs, second, nodes, k, num, den, frequencies)
        discard(labels)
        labels = materialise(components(links.unionAll(more)), compact=True)
        discard(more)
    discard(meetings, labelled, under, first, second, links)

    named = nodes.join(labels, "node", "left").select("cid", "least", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "component").select("cid", "component_id")
    out = rows.select("doc_id", "h", F.col("n").alias("n_shingles"), "cid").join(by_class, "cid", "left")
    out = materialise(out.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), compact=True)
    discard(rows, nodes, labels)
    return out


def _members(rows: DataFrame, under: DataFrame, column: str) -> DataFrame:
    """The rows, and once more for every class that stands under the group in ``column``."""
    more = under.select(F.col("g").alias(column), F.col("node").alias("_node"))
    return rows.unionByName(rows.join(more, column).drop(column).withColumnRenamed("_node", column))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near duplicates: of each component the row of the smallest id stays, rows equal in id and text once.

    Texts without words, and components without any id, stay as they are.
    """
    found = jaccard_components(docs, k, num, den)
    worded = F.col("n_shingles") > 0
    stays = found.filter(~worded | F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).groupBy("doc_id", "h").agg(F.count("*").alias("rows"), F.max(worded).alias("worded"))
    # Of several texts with the smallest id, the one with the least hash.
    least = stays.filter("worded and doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("least"))
    stays = stays.join(least, "doc_id", "left").filter("least is null or h = least or not worded").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("rows").alias("_rows"))
    repeated = stays.filter("_rows > 1").limit(1).count() > 0
    text_hash = F.xxhash64("text")
    out = docs.join(stays, docs["doc_id"].cast("bigint").eqNullSafe(stays["_id"]) & (text_hash == stays["_h"]), "left_semi")
    return out.dropDuplicates(["doc_id", "text"]) if repeated else out
