from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Row

from bibliospark.llm import packing, sstable
from bibliospark.llm.queries import op1_sstable, op8_packing, tokenizer_path
from bibliospark.llm.tokens import Encoder, encoder

SCHEMA = "doc_id long, text string, ids string, path string"
ODD = [Row(5, "a  b \n c", "x", "p"), Row(5, "a  b \n c", "x", "p"), Row(3, None, None, None), Row(None, "no id", "", ""), Row(1, "", "", ""), Row(-7, "wort " * 40_000, "", ""), Row(9, "x<|endoftext|> y <|endoftext|>", "", "")]


def direct(text: str | None) -> list[int]:
    return encoder(tokenizer_path()).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" \n\t'sab1.,!é€  \u0085\x1c<|endoftext|>"), max_size=40) | st.text(max_size=30))
def test_pieces_equal_whole_texts(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    code = encoder(tokenizer_path())
    assert np.frombuffer(code.packed([text])[0], code.type).tolist() == direct(text)


def test_small_memory_gives_the_same():
    code = Encoder(tokenizer_path())
    code.pieces.bound, code.words.bound = 3, 2
    for text in ("one two three four five six", "two, three. four's 12 13", "one one"):
        assert np.frombuffer(code.packed([text])[0], code.type).tolist() == direct(text)


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def expected_tokens(rows):
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = direct(text) + [2]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_op1_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = [tuple(r) for r in op1_sstable(spark, sf_dir).collect()]
    assert sorted(got) == expected_tokens(rows)


@pytest.mark.parametrize("rows", [ODD, []])
def test_shards_of_odd_rows(spark, rows):
    manifest = sstable.write_shards(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), end_id=2, block_bytes=64, shards=3)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in sstable.read_shards(manifest).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected_tokens([(r[0], r[1]) for r in rows])


def test_lookup(spark):
    docs = spark.createDataFrame([(i // 2 * 3, f"text number {i}") for i in range(200)], "doc_id long, text string")
    manifest = sstable.write_shards(docs, tokenizer_path(), end_id=2, block_bytes=100, shards=3)
    wanted = spark.createDataFrame([(i,) for i in range(-5, 310)], "doc_id long")
    got = defaultdict(set)
    for r in sstable.lookup(manifest, wanted).collect():
        got[r.doc_id].add(tuple(np.frombuffer(r.ids, "<u4").tolist()))
    assert got == {i * 3: {tuple(direct(f"text number {i * 2}") + [2]), tuple(direct(f"text number {i * 2 + 1}") + [2])} for i in range(100)}


def check_pieces(texts: dict[int, list], pieces):
    """Each id once, sequences gapless and padded little; texts: doc_id -> its texts."""
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append(p)
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert set(docs) == set(texts)
    total = 0
    for doc_id, own in docs.items():
        expected = sorted((direct(t) + [0] for t in texts[doc_id]), key=len)
        assert sum(p.length for p in own) == sum(map(len, expected))
        total += sum(p.length for p in own)
        if len(expected) == 1:
            ids, at = expected[0], 0
            for p in sorted(own, key=lambda p: p.start):
                assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[at : at + p.length])
                at += p.length
    assert padding <= 0.02 * total
    return sequences


def test_op8_on_documents(spark, sf_dir):
    texts = {r.doc_id: [r.text] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = op8_packing(spark, sf_dir).collect()
    sequences = check_pieces(texts, pieces)
    lengths = defaultdict(int)
    for sequence, length in {(p.sequence_id, p.sequence_length) for p in pieces}:
        lengths[length] += 1
    assert lengths[1024] > 0.8 * len(sequences)


@pytest.mark.parametrize("rows", [ODD, []])
def test_packing_of_odd_rows(spark, rows):
    from pyspark.sql import functions as F

    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    out = packing.pack_documents(spark.createDataFrame(rows, SCHEMA), tokenizer_path(), end_id=0, bundle_bytes=2000)
    check_pieces(texts, out.withColumn("ids_crc32", F.crc32("ids")).collect())


def test_lookup_of_a_null_identifier(spark):
    manifest = sstable.write_shards(spark.createDataFrame([(None, "a b"), (1, "c"), (2, "d"), (2, "e")], "doc_id long, text string"), tokenizer_path(), end_id=2, shards=2)
    wanted = spark.createDataFrame([(None,), (2,), (5,)], "doc_id long")
    assert sorted(str(r.doc_id) for r in sstable.lookup(manifest, wanted).collect()) == ["2", "2", "None"]


def test_steps_are_balanced(spark, sf_dir):
    sizes = sorted(r[1] for r in op8_packing(spark, sf_dir).groupBy("step").sum("length").collect())
    assert len(sizes) > 1 and sizes[-1] <= 1.05 * sizes[len(sizes) // 2] and sizes[len(sizes) // 4] >= 0.95 * sizes[len(sizes) // 2]  # the last of a task may be short
