"""Toxicity: a counterfactual-regularised linear classifier over words and word beginnings.

Words are runs of letters, digits and non-ASCII bytes in lower case; a term is a word, or the first 4 to 8
bytes of a longer one, so that inflected and compound words share evidence.  A term counts at three levels:
the text holds it; it holds it twice or more and once in 400 words; twice or more and once in 100 words.  The
vocabulary holds terms some level of which is more or less frequent among toxic texts beyond chance.  A
logistic regression on these levels is fitted together with a penalty on score changes: in every labelled
text that names a group, identity terms are swapped for others of their kind, and the squared change of the
log-odds counts against the model.  So a neutral mention of a group doesn't raise a score.

At most ``max_rows`` labelled rows and ``max_terms`` terms, both parameters of ``train``, fit the model; scoring is one pass over the texts.

Defined results: null, empty and white texts hold no term and get the score of those; very long texts are scored
whole, some words at a time; repeated rows get equal
scores; an id that several rows of documents have takes no part in the fit; other columns are kept (``remove_toxic``), or left out (``score``); without labelled rows, or with one label only, the smoothed rate of label 1 is everyone's score; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.decontam import _WORD
from tessera.llm.labelled import labelled_sample
from tessera.llm.store import map_rows
from tessera.llm.textblocks import BLOCK_BYTES, LOWER, apart_hashes, blocks, prefix_hashes, runs, span_hashes

#: Terms of each kind are swapped for the next one of it.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european", "american"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("man", "woman"),
    ("men", "women"),
    ("male", "female"),
    ("young", "old", "elderly"),
    ("deaf", "blind", "disabled"),
    ("immigrant", "refugee", "foreigner"),
    ("immigrants", "refugees", "foreigners"),
    # German
    ("christ", "moslem", "jude"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten"),
    *(tuple(stem + end for stem in ("christlich", "muslimisch", "jüdisch", "hinduistisch", "buddhistisch", "atheistisch")) for end in ("", "e", "em", "en", "er", "es")),
    *(tuple(stem + end for stem in ("schwarz", "weiß", "asiatisch", "arabisch", "afrikanisch", "europäisch", "amerikanisch")) for end in ("e", "em", "en", "er", "es")),
    ("schwul", "lesbisch", "bisexuell", "heterosexuell", "transsexuell"),
    ("mann", "frau"),
    ("männer", "frauen"),
    ("männlich", "weiblich"),
    ("gehörlos", "sehbehindert", "behindert"),
    ("einwanderer", "flüchtling", "ausländer"),
    # French
    ("chrétien", "musulman", "juif", "hindou", "bouddhiste", "athée"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("chrétienne", "musulmane", "juive", "hindoue"),
    ("chrétiennes", "juives", "hindoues"),
    ("noir", "blanc", "asiatique", "arabe", "africain", "européen", "américain"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens", "américains"),
    ("noire", "blanche", "africaine", "européenne", "américaine"),
    ("noires", "blanches", "africaines", "européennes", "américaines"),
    ("homosexuel", "lesbienne", "bisexuel", "hétérosexuel", "transgenre"),
    ("homme", "femme"),
    ("hommes", "femmes"),
    ("masculin", "féminin"),
    ("jeune", "vieux", "âgé"),
    ("sourd", "aveugle", "handicapé"),
    ("immigré", "réfugié", "étranger"),
    ("immigrés", "réfugiés", "étrangers"),
    # Spanish
    ("cristiano", "musulmán", "judío", "hindú", "budista", "ateo"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("cristiana", "musulmana", "judía"),
    ("cristianas", "musulmanas", "judías"),
    ("negro", "blanco", "asiático", "árabe", "africano", "europeo", "americano"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos", "americanos"),
    ("negra", "blanca", "asiática", "africana", "europea", "americana"),
    ("negras", "blancas", "asiáticas", "africanas", "europeas", "americanas"),
    ("homosexual", "lesbiana", "heterosexual", "transgénero"),
    ("hombre", "mujer"),
    ("hombres", "mujeres"),
    ("masculino", "femenino"),
    ("joven", "viejo", "anciano"),
    ("sordo", "ciego", "discapacitado"),
    ("inmigrante", "refugiado", "extranjero"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
# Texts are lower-cased in A-Z alone, so other letters are listed as a capital and in capitals too.
SWAP = {form(kind[i]).encode().lower(): kind[(i + 1) % len(kind)].encode() for form in (str.upper, str.capitalize, str) for kind in IDENTITY_TERMS for i in range(len(kind))}
MAX_ROWS, MAX_TERMS, LEAST_TEXTS, LEAST_Z = 20_000, 4_096, 4, 5.0
STEPS, CG_STEPS, RIDGE, SWAP_WEIGHT = 30, 60, 1e-4, 1.0
BEGINNINGS = (4, 5, 6, 7, 8)
LEVELS = 3
#: Words that are worked on at once.
SLICE = 200_000


def swap_identities(text: bytes, limit: int = BLOCK_BYTES) -> bytes:
    """The lower-cased text with each identity term replaced by the next one of its kind, a stretch at a time."""
    text, out, a = text.lower(), [], 0
    while a < len(text):
        b = min(a + limit, len(text))
        while b < len(text) and _WORD[text[b - 1]] and _WORD[text[b]]:
            b += 1
        out.append(re.sub(rb"[0-9a-z\x80-\xff]+", lambda m: SWAP.get(m[0], m[0]), text[a:b]))
        a = b
    return b"".join(out)


def term_counts(data: np.ndarray, offsets: np.ndarray, vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of a block's terms, by text and term, and the texts' numbers of words.

    A term is its hash, or its number in the vocabulary, if there is one, and others are left out.  Words are
    worked on ``SLICE`` at a time, so that a very long text takes the memory of its different terms.
    """
    starts, ends = runs(_WORD[data], offsets)
    words = np.diff(np.searchsorted(starts, offsets))
    owner, parts = np.repeat(np.arange(len(offsets) - 1), words), []
    for a in range(0, len(starts), SLICE):
        begin, end, text = starts[a : a + SLICE], ends[a : a + SLICE], owner[a : a + SLICE]
        piece = data[begin[0] : end[-1]]
        begin, end = begin - begin[0], end - begin[0]
        if len(piece) <= 8 * BLOCK_BYTES:
            prefix = prefix_hashes(LOWER[piece])
            hashed = lambda a, b, prefix=prefix: span_hashes(prefix, a, b)
        else:  # words of megabytes
            hashed = lambda a, b, piece=piece: apart_hashes(piece, a, b, LOWER)
        hashes, owners = [hashed(begin, end)], [text]
        for n in BEGINNINGS:
            long = end - begin > n
            hashes.append(hashed(begin[long], begin[long] + n) + np.uint64(n))
            owners.append(text[long])
        term, text = np.concatenate(hashes), np.concatenate(owners)
        if vocabulary is None:
            parts.append(_summed(text, term, np.ones(len(text), np.int64)))
        elif len(vocabulary):
            at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
            hit = np.flatnonzero(vocabulary[at] == term)
            both, times = np.unique(text[hit] * len(vocabulary) + at[hit], return_counts=True)
            parts.append((both // len(vocabulary), (both % len(vocabulary)).astype(np.uint64), times))
    if not parts:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, words
    if len(parts) > 1:
        parts = [_summed(*(np.concatenate(x) for x in zip(*parts)))]
    return *parts[0], words


def _summed(text: np.ndarray, term: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((term, text))
    text, term = text[order], term[order]
    edge = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (text[1:] != text[:-1])])) if len(order) else order
    return text[edge], term[edge], np.add.reduceat(times[order], edge) if len(edge) else times[:0]


def levels(times: np.ndarray, words: np.ndarray) -> np.ndarray:
    """How many levels a term reaches that stands ``times`` times in ``words`` words."""
    often = times >= 2
    return 1 + (often & (times * 400 >= words)) + (often & (times * 100 >= words))


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray  # sorted hashes of terms
    weights: np.ndarray  # by term and level
    bias: float

    def entries(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of term and level) of all levels reached."""
        text, term, times, words = term_counts(data, offsets, self.vocabulary)
        term = term.astype(np.int64)
        reached = levels(times, words[text])
        which = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
        return np.repeat(text, reached), np.repeat(term, reached) * LEVELS + which

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, entry = self.entries(data, offsets)
        total = self.bias + np.bincount(text, self.weights[entry], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(v: int, y: np.ndarray, rows: np.ndarray, entries: np.ndarray, moved: np.ndarray, moved_entries: np.ndarray, moved_by: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of v entries and the bias.

    (rows, entries): what each text reaches.  (moved, moved_entries, moved_by): what swapping identity terms adds
    to (+1) or takes from (-1) a text.  Newton's method on the penalised likelihood; conjugate gradients solve
    each step.
    """
    n = len(y)
    rate = (y.sum() + 1) / (n + 2)
    bias = float(np.log(rate / (1 - rate)))
    if not v or len(np.unique(y)) < 2:
        return np.zeros(v), bias
    swapped = max(len(np.unique(moved)), 1)
    ridge = np.append(np.full(v, RIDGE), 0)  # the last entry is the bias, which no penalty touches

    def margins(w: np.ndarray) -> np.ndarray:
        return w[v] + np.bincount(rows, w[entries], n)

    def changes(w: np.ndarray) -> np.ndarray:
        return np.bincount(moved, w[moved_entries] * moved_by, n)

    def back(off: np.ndarray, change: np.ndarray) -> np.ndarray:
        out = np.append(np.bincount(entries, off[rows], v), off.sum()) / n
        out[:v] += 2 * SWAP_WEIGHT / swapped * np.bincount(moved_entries, change[moved] * moved_by, v)
        return out

    def loss(w: np.ndarray) -> float:
        m = margins(w)
        return float((np.logaddexp(0, m) - y * m).mean() + 0.5 * (ridge * w * w).sum() + SWAP_WEIGHT / swapped * (changes(w) ** 2).sum())

    w = np.append(np.zeros(v), bias)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(margins(w), -30, 30)))
        slope = back(p - y, changes(w)) + ridge * w
        step, left = np.zeros(v + 1), -slope
        way, norm = left.copy(), left @ left
        for _ in range(CG_STEPS):
            if norm < 1e-16:
                break
            curve = back(p * (1 - p) * margins(way), changes(way)) + (ridge + 1e-9) * way
            size = norm / max(way @ curve, 1e-300)
            step, left = step + size * way, left - size * curve
            norm, before = left @ left, norm
            way = left + norm / before * way
        size, now = 1.0, loss(w)
        while size > 1e-4 and loss(w + size * step) > now + 1e-4 * size * (slope @ step):
            size /= 2
        if size <= 1e-4 or np.abs(size * step).max() < 1e-5:
            break
        w = w + size * step
    return w[:v], float(w[v])


def choose_vocabulary(sample: DataFrame, max_terms: int = MAX_TERMS) -> np.ndarray:
    """Hashes of the terms one level of which splits toxic from other texts by LEAST_Z standard errors, the surest ``max_terms``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.asarray(batch.column(1))
            for low, _, data, offsets in blocks(batch.column(0)):
                text, hashes, times, words = term_counts(data, offsets)
                reached = levels(times, words[text])
                toxic = label[low + text].astype(np.float64)
                for level in range(1, LEVELS + 1):
                    keys, which = np.unique(hashes[reached >= level], return_inverse=True)
                    if len(keys):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys.view(np.int64)),
                                pa.array(np.full(len(keys), level, np.int32)),
                                pa.array(np.bincount(which)),
                                pa.array(np.bincount(which, toxic[reached >= level]).astype(np.int64)),
                            ],
                            names=["term", "level", "texts", "toxic"],
                        )

    share = sample.select(F.avg("label").alias("share"))
    counts = sample.mapInArrow(run, "term bigint, level int, texts bigint, toxic bigint").groupBy("term", "level").agg(F.sum("texts").alias("texts"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("texts") * F.col("share")) / F.sqrt(F.greatest(F.col("texts") * F.col("share") * (1 - F.col("share")), F.lit(1e-9)))
    sure = counts.filter(F.col("texts") >= LEAST_TEXTS).join(F.broadcast(share)).select("term", F.abs(z).alias("z")).filter(F.col("z") >= LEAST_Z)
    rows = sure.groupBy("term").agg(F.max("z").alias("z")).orderBy(F.desc("z"), "term").limit(max_terms).collect()
    return np.sort(np.array([r["term"] for r in rows], np.int64).view(np.uint64))


def train(docs: DataFrame, labels: DataFrame, mod: int = 5, held_out: int = 0, max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> ToxicityModel:
    sample = labelled_sample(docs, labels, "toxic", mod, held_out, max_rows)
    vocabulary = choose_vocabulary(sample, max_terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = ToxicityModel(vocabulary, np.zeros(0), 0.0)
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(0)):
                n = high - low
                texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                other = [swap_identities(t) for t in texts]
                sides = []
                for raw in (texts, other):
                    at = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
                    text, entry = model.entries(np.frombuffer(b"".join(raw), np.uint8), at)
                    sides.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32)), pa.array(entry.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, n), *sides], names=["label", "entries", "swapped"])

    held = sample.mapInArrow(run, "label int, entries array<int>, swapped array<int>").toArrow()
    y, v = held.column("label").to_numpy().astype(float), len(vocabulary) * LEVELS
    sides = []
    for name in ("entries", "swapped"):
        lists = pa.concat_arrays(held.column(name).chunks) if len(y) else pa.array([], pa.list_(pa.int32()))
        sides.append((np.repeat(np.arange(len(y)), np.diff(np.asarray(lists.offsets))), np.asarray(lists.flatten()).astype(np.int64)))
    (rows, entries), (other, other_entries) = sides
    moved = np.concatenate([other * max(v, 1) + other_entries, rows * max(v, 1) + entries])
    by = np.concatenate([np.ones(len(other)), -np.ones(len(rows))])
    keys, which = np.unique(moved, return_inverse=True)
    total = np.bincount(which, by) if len(keys) else np.zeros(0)
    keys, total = keys[total != 0], total[total != 0]
    weights, bias = fit(v, y, rows, entries, keys // max(v, 1), keys % max(v, 1), total)
    return ToxicityModel(vocabulary, weights, bias)


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and score, the model's probability of label 1, for each row."""
    names = [*keep, *(["text"] if "text" not in keep else [])]
    text = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(text)):
                kept = batch.slice(low, high - low).columns[: len(keep)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(data, offsets))], names=[*keep, "score"])

    rows = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, f"{schema}, score double")


def remove_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score less than ``threshold``, in one pass and without a shuffle."""

    text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in blocks(batch.column(text)):
                yield batch.slice(low, high - low).filter(pa.array(model.score(data, offsets) < threshold))

    return map_rows(docs, run)
