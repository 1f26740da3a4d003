"""Linear-grouping packing: plans of many histograms, against bounds and plain best fit, and exact round trips."""

import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import grouping
from tessera.llm.packing import best_fit_decreasing
from tessera.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def windows_of(plan, histogram, capacity):
    """Every piece's (window, offset, length), from the steps one by one; ranks must be gapless."""
    seen, out = Counter(), {}
    steps = sorted(plan.steps)
    for i, (length, rank, first, each, offset) in enumerate(steps):
        end = steps[i + 1][1] if i + 1 < len(steps) and steps[i + 1][0] == length else histogram[length]
        assert rank == seen[length]
        for k in range(end - rank):
            out.setdefault(first + k // each, []).append((offset + k % each * length, length))
        seen[length] = end
    assert seen == Counter({k: v for k, v in histogram.items() if v})
    assert set(out) == set(range(plan.windows))
    for held in out.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return out


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30), st.sampled_from(grouping.VARIANTS))
def test_plans_place_every_piece_once(histogram, variant):
    windows_of(grouping.Plan(histogram, 64, *variant), histogram, 64)


@pytest.mark.parametrize("low, high", [(1, 4096), (1000, 4000), (1100, 1700), (1300, 2100), (1, 600), (2049, 4096), (4096, 4097)])
def test_plans_are_tight(low, high):
    lengths = np.random.default_rng(low).integers(low, high, 20_000)
    histogram = dict(Counter(lengths.tolist()))
    plan = grouping.planned(histogram, 4096)
    windows_of(plan, histogram, 4096)
    assert -(-int(lengths.sum()) // 4096) <= plan.windows <= best_fit_decreasing(lengths, 4096)[2] * 1.001


def test_configurations_beat_plain_best_fit():
    """Lengths of a little over a quarter to two fifths of a window: which sizes go together matters."""
    lengths = np.random.default_rng(0).integers(1100, 1700, 50_000)
    plan = grouping.planned(dict(Counter(lengths.tolist())), 4096)
    assert plan.windows < 0.95 * best_fit_decreasing(lengths, 4096)[2]


def test_work_does_not_grow_with_counts():
    rnd = random.Random(2)
    small = {n: rnd.randrange(1, 50) for n in range(1, 4096, 3)}
    big = {n: c * 10**8 for n, c in small.items()}
    plan = grouping.planned(big, 4096)
    assert len(plan.steps) < 40_000 and max(r for _, r, *_ in plan.steps) < 1 << 48
    assert plan.windows >= sum(n * c for n, c in big.items()) // 4096
    assert plan.windows <= 1.01 * grouping.planned(small, 4096).windows * 10**8


def test_configurations_are_feasible_and_leave_little():
    sizes, demand = [3000, 2500, 2048, 1500, 1100, 900], [70, 111, 500, 333, 1000, 41]
    left = list(demand)
    for times, config in grouping.configurations(sizes, demand, 4096):
        assert sum(s * c for s, c in zip(sizes, config)) <= 4096
        left = [n - times * c for n, c in zip(left, config)]
    assert min(left) >= 0 and sum(left) <= 7 * len(sizes)


def packed(rows, spark, capacity, parts):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, length int, sequence_id string").repartition(parts)
    return grouping.pack(docs, PATH, end_id=1, capacity=capacity).collect()


@pytest.mark.parametrize("parts, limit", [(1, 200_000), (7, 200_000), (7, 3)])
def test_round_trip(spark, odd_rows, monkeypatch, parts, limit):
    monkeypatch.setattr(grouping, "SMALL_ROWS", limit)  # the join is broadcast or shuffled
    got = packed(odd_rows, spark, 64, parts)
    enc = Encoder(PATH)
    want = Counter()
    for doc_id, text in odd_rows:
        ids = enc.tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 64):
            want[doc_id, p // 64, p, tuple(ids[p : p + 64])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], np.uint32).tolist())) for r in got) == want
    by_sequence = {}
    for r in got:
        assert r["length"] * 4 == len(r["ids"])
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 64
    lengths = np.array([r["length"] for r in got])
    assert len(by_sequence) <= best_fit_decreasing(lengths, 64)[2] + 1


def test_no_rows(spark):
    assert packed([], spark, 64, 2) == []
    assert [(r["length"], r["offset"]) for r in packed([(None, None)], spark, 64, 1)] == [(1, 0)]
