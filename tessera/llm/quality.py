"""Quality classifier: a generalised additive model with pairwise interactions.

Features are shape statistics of the whole text (no words, no metadata).  Boosting goes round the features in
turn; each step fits a tree of at most four leaves on one feature's bins and adds it, shrunk, to that
feature's lookup table.  Then the pairs whose residual interaction is strongest get two-way tables, boosted the
same way.  A score is the logistic function of the sum of the table entries at the text's bins.

At most ``labelled.MAX_ROWS`` labelled rows fit the model, on the driver; scoring is one pass over the texts.

Defined results: null, empty and white texts have all-zero features and get the score of those; very long texts
are measured whole (a task holds some 20 bytes for each of their bytes); repeated rows
get equal scores; an id that several rows of documents have takes no part in the fit; other columns are left out; without labelled rows, or with one label only, the smoothed rate of label 1 is everyone's
score; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.labelled import MAX_ROWS, labelled_sample
from tessera.llm.textblocks import LOWER, SPACE, apart_hashes, blocks, runs, shingle_hashes

FEATURES = (
    "log_words", "mean_word_bytes", "long_words", "upper", "digits", "marks", "signs", "bars", "exclamations", "non_ascii",
    "full_stops", "lines", "line_words", "distinct_words", "commonest_word", "repeated_next", "distinct_trigrams", "distinct_lines",
)
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15


def _table(*bytes_: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


_KINDS = {
    "upper": _table(*range(65, 91)),
    "digits": _table(*range(48, 58)),
    "marks": _table(*b",.;:?'\"()-"),
    "signs": _table(*b"#$%&*+/<=>@[\\]^_`{}~"),
    "bars": _table(ord("|")),
    "exclamations": _table(ord("!")),
    "non_ascii": _table(*range(128, 256)),
    "full_stops": _table(ord(".")),
}


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text of a block."""
    n = len(offsets) - 1
    out = dict.fromkeys(FEATURES, None)
    starts, ends = runs(~SPACE[data], offsets)
    first = np.searchsorted(starts, offsets)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    size = np.concatenate([[0], np.cumsum(ends - starts)])
    letters = np.maximum(np.diff(size[first]), 1)
    out["log_words"], out["mean_word_bytes"] = np.log1p(count), np.diff(size[first]) / some
    long = np.concatenate([[0], np.cumsum(ends - starts > 14)])
    out["long_words"] = np.diff(long[first]) / some
    for name, kind in _KINDS.items():
        at = np.flatnonzero(kind[data])
        out[name] = np.diff(np.searchsorted(at, offsets)) / letters
    words = apart_hashes(data, starts, ends, LOWER)
    line_starts, line_ends = runs(data != 10, offsets)
    line_first = np.searchsorted(line_starts, offsets)
    line_hash = apart_hashes(data, line_starts, line_ends, LOWER)
    lines = np.diff(line_first).astype(float)
    out["lines"], out["line_words"] = lines / some, count / np.maximum(lines, 1)
    trigrams, tri_at = shingle_hashes(words, first, 3)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words) > 1:
        same[2:] = np.cumsum(words[1:] == words[:-1])
    distinct, commonest, tri, line = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        own = np.sort(words[a:b])
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
        distinct[i], commonest[i] = (len(edge) - 1) / (b - a), np.diff(edge).max() / (b - a)
        grams = np.sort(trigrams[tri_at[i] : tri_at[i + 1]])
        tri[i] = 1 - np.count_nonzero(grams[1:] == grams[:-1]) / len(grams)
        whole = np.sort(line_hash[line_first[i] : line_first[i + 1]])
        line[i] = 1 - np.count_nonzero(whole[1:] == whole[:-1]) / max(len(whole), 1)
    out["distinct_words"], out["commonest_word"], out["distinct_trigrams"], out["distinct_lines"] = distinct, commonest, tri, line
    out["repeated_next"] = np.where(count > 1, (same[first[1:]] - same[np.minimum(first[:-1] + 1, len(words))]) / some, 0)
    table = np.stack([out[f] for f in FEATURES], axis=1)
    table[count == 0] = 0
    return table


@dataclass
class AdditiveModel:
    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, cut) of the best split of a row of bins into [:cut] and [cut:]."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    cut = int(np.argmax(gain))
    return float(gain[cut]), cut + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values, by bin, of a tree of depth two on one feature."""
    _, middle = _best_cut(g, h)
    cuts = {0, len(g), middle}
    for a, b in ((0, middle), (middle, len(g))):
        gain, cut = _best_cut(g[a:b], h[a:b])
        if gain > 1e-9:
            cuts.add(a + cut)
    out = np.zeros(len(g))
    for a, b in zip(sorted(cuts), sorted(cuts)[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, leaf values) of a tree that cuts the first feature, then each side on the second; or the other way round."""
    best: tuple[float, np.ndarray] = (-1.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        for cut in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), -_gain(gg.sum(), hh.sum())
            for side in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[side].sum(0), hh[side].sum(0)
                _, at = _best_cut(sg, sh)
                for part in (slice(0, at), slice(at, None)):
                    gain += _gain(sg[part].sum(), sh[part].sum())
                    out[side, part] = sg[part].sum() / (sh[part].sum() + 1.0)
            if gain > best[0]:
                best = (float(gain), out.T if turned else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    rate = (y.sum() + 1) / (len(y) + 2)
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    if len(np.unique(y)) < 2:
        return model
    width = x.shape[1]
    model.edges = [_edges(x[:, f], BINS) for f in range(width)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    bins = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(width)]
    total = np.full(len(y), model.base)

    def slopes(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(at, y - p, size), np.bincount(at, p * (1 - p), size)

    for _ in range(ROUNDS):
        for f in range(width):
            step = RATE * _tree(*slopes(bins[f], len(model.tables[f])))
            model.tables[f] += step
            total += step[bins[f]]
    model.pair_edges = [_edges(x[:, f], PAIR_BINS) for f in range(width)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]
    ranked = []
    for a, b in combinations(range(width), 2):
        g, h = slopes(coarse[a] * sizes[b] + coarse[b], sizes[a] * sizes[b])
        ranked.append((_pair_tree(g.reshape(sizes[a], -1), h.reshape(sizes[a], -1))[0], a, b))
    model.pairs = [(a, b) for gain, a, b in sorted(ranked, reverse=True)[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes(coarse[a] * sizes[b] + coarse[b], sizes[a] * sizes[b])
            step = RATE * _pair_tree(g.reshape(sizes[a], -1), h.reshape(sizes[a], -1))[1]
            model.pair_tables[k] += step
            total += step[coarse[a], coarse[b]]
    return model


def train(docs: DataFrame, labels: DataFrame, mod: int = 3, held_out: int = 1, max_rows: int = MAX_ROWS) -> AdditiveModel:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(list(features(data, offsets)), pa.list_(pa.float64())), batch.column(1).slice(low, high - low)], names=["x", "label"])

    rows = labelled_sample(docs, labels, "quality", mod, held_out, max_rows).mapInArrow(run, "x array<double>, label int").toArrow()
    y = rows.column("label").to_numpy().astype(float)
    x = np.array(rows.column("x").combine_chunks().flatten()).reshape(len(y), len(FEATURES)) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order in which rows arrive
    return fit(x[order], y[order])


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """doc_id, score: the model's probability of label 1 for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(model.score(features(data, offsets)))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")
