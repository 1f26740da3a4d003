"""Text blocks, the tokenizer's memo, packing and token files against the libraries they must equal."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import packing, tokenfile
from tessera.llm.store import discard, materialise, shared_dir
from tessera.llm.textblocks import blocks, shingle_hashes, word_hashes
from tessera.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return Encoder(PATH)


def whole(encoder, texts):
    out = []
    for low, high, data, offsets in blocks(pa.array(texts, pa.string()), 64):
        ids, at = encoder.encode(data, offsets)
        out += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]
    return out


def direct(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer(encoder, odd_rows):
    texts = [t for _, t in odd_rows]
    assert whole(encoder, texts) == [direct(encoder, t) for t in texts]
    assert whole(encoder, texts) == [direct(encoder, t) for t in texts]  # from the memo


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aAbZéÉßÿ×÷ 'sStT<|>x1２\n\t.,!#-日ΣσǺ \x1c", max_size=30), max_size=6))
def test_encoder_equals_tokenizer_on_any_text(texts):
    encoder = Encoder(PATH)
    assert whole(encoder, texts) == [direct(encoder, t) for t in texts]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr("tessera.llm.tokens.MEMO_ENTRIES", 50)
    encoder = Encoder(PATH)
    texts = [f"word{i} other{i}" for i in range(200)]
    assert whole(encoder, texts) == [direct(encoder, t) for t in texts]
    assert len(encoder.hashes) <= 60


def test_blocks_hide_bytes_under_nulls():
    column = pa.Array.from_buffers(pa.string(), 3, [pa.py_buffer(b"\x05"), pa.py_buffer(np.array([0, 2, 4, 6], np.int32).tobytes()), pa.py_buffer(b"aabbcc")])
    (low, high, data, offsets) = next(blocks(column))
    assert (low, high, data.tobytes(), offsets.tolist()) == (0, 3, b"aacc", [0, 2, 2, 4])


def test_words_and_shingles():
    texts = ["The  cat\tsat", "the cat", "", "a b c d", "A b C d e"]
    _, _, data, offsets = next(blocks(pa.array(texts)))
    hashes, _, _, first = word_hashes(data, offsets)
    assert np.diff(first).tolist() == [3, 2, 0, 4, 5]
    assert hashes[0] == hashes[3]
    grams, at = shingle_hashes(hashes, first, 3)
    assert np.diff(at).tolist() == [1, 1, 0, 2, 3]
    assert grams[2] == grams[4] and grams[3] == grams[5] and grams[0] != grams[1]


def test_packing_round_trip(odd_docs, odd_rows, encoder):
    got = packing.pack(odd_docs, PATH, end_id=2, capacity=64).collect()
    assert sum(r["start"] == 0 for r in got) == len(odd_rows)
    by_sequence = {}
    for r in got:
        assert 1 <= r["length"] <= 64 and len(r["ids"]) == 4 * r["length"]
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    texts = {}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] not in (6,):
            texts.setdefault(r["doc_id"], {})[r["start"]] = np.frombuffer(r["ids"], "<u4").tolist()
    for i, t in odd_rows:
        if i is not None and i != 6:
            ids = [x for s in sorted(texts[i]) for x in texts[i][s]]
            assert ids == [*direct(encoder, t), 2]


def test_packing_is_tight_and_first_fit_exact():
    lengths = np.random.default_rng(1).integers(1, 4097, 3000)
    window, offset, opened = packing.best_fit_decreasing(lengths, 4096)
    fill = np.bincount(window, lengths, opened)
    assert fill.max() <= 4096 and opened <= 1.02 * lengths.sum() / 4096 + 1 or opened <= np.count_nonzero(lengths > 2048) + 50
    # brute force: the tightest open window each time
    room = []
    for n in sorted(lengths.tolist(), reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(4096 - n)
    assert sorted(4096 - fill) == sorted(room)


def test_packing_in_groups(odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_DOCUMENTS", 4)
    got = packing.pack(odd_docs.coalesce(1), PATH, 2, 64)
    assert got.select("doc_id", "start").count() == packing.pack(odd_docs, PATH, 2, 64).count()


@pytest.mark.parametrize("partitions", [1, 32, 211])
def test_padding_does_not_grow_with_partitions(spark, partitions):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(partitions)
    got = packing.pack(docs, PATH, 2, 1024).groupBy("sequence_id").agg(F.sum("length").alias("fill")).collect()
    assert max(r["fill"] for r in got) <= 1024
    assert sum(r["fill"] for r in got) >= 0.99 * 1024 * len(got)


def test_a_very_long_text(spark, encoder):
    text = "Wort it's 12 Größe, " * 100_000 + "x" * 700_000 + " ende"
    docs = spark.createDataFrame([(1, text), (2, "kurz")], "doc_id bigint, text string")
    ids = [*direct(encoder, text), 2]
    got = {r["start"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(docs, PATH, 2, 4096).filter("doc_id = 1").collect()}
    assert [x for s in sorted(got) for x in got[s]] == ids


def test_token_files(spark, odd_docs, odd_rows, encoder):
    path = shared_dir(spark)
    tokenfile.write_token_files(odd_docs, path, PATH, 1, metadata=["lang", "source"])
    read = tokenfile.read_token_files(spark, path)
    got = sorted(tokenfile.token_checksums(read.select("doc_id", "start", "n_tokens", "tokens")).collect(), key=lambda r: r["start"])
    want, at = [], 0
    for i, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32(r[1].encode()) if r[1] is not None else -1)):
        ids = np.array([*direct(encoder, t), 1], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got] == want
    plan = read.select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "tokens:array" not in plan
    files = [f.removeprefix("file:") for f in spark.read.parquet(path).inputFiles()]
    column = next(c for c in (pq.ParquetFile(files[0]).metadata.row_group(0).column(k) for k in range(8)) if "tokens.list" in c.path_in_schema)
    assert any("DICTIONARY" in e for e in column.encodings) and column.has_offset_index


def test_metadata_with_clashing_names(spark):
    path = shared_dir(spark)
    docs = spark.createDataFrame([(1, "a b", "x", 5, "q"), (2, None, None, 6, None)], "doc_id bigint, text string, tokens string, Start int, `a.b` string")
    tokenfile.write_token_files(docs, path, PATH, 1, metadata=["tokens", "Start", "a.b"])
    read = tokenfile.read_token_files(spark, path).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["start"], len(r["tokens"]), r["tokens_"], r["Start_"], r["a.b"]) for r in read] == [(1, 0, 3, "x", 5, "q"), (2, 3, 1, None, 6, None)]


def test_numbers_are_delta_encoded_and_pages_indexed(spark, odd_docs):
    path = shared_dir(spark)
    tokenfile.write_token_files(odd_docs, path, PATH, 1)
    for f in spark.read.parquet(path).inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file:")).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["first_token"].encodings and "DELTA_BINARY_PACKED" in columns["n_tokens"].encodings
            assert all(c.has_offset_index for c in columns.values()) and columns["doc_id"].has_column_index and columns["first_token"].statistics.has_min_max


def test_empty_tables(spark, no_docs):
    assert packing.pack(no_docs, PATH, 2).count() == 0
    path = shared_dir(spark)
    tokenfile.write_token_files(no_docs, path, PATH, 1)
    assert tokenfile.token_checksums(tokenfile.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "tokens")).count() == 0


def test_materialised_tables_can_go(spark):
    held = materialise(spark.range(3).select(F.col("id")))
    assert held.count() == 3
    discard(held)
