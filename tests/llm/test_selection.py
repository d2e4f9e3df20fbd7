"""Exact deduplication, importance resampling and hard negatives against brute force on small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliospark.llm import exact, hardneg, resample

BLANKS = re.compile(r"[\x20\x09-\x0D]+")


def docs_of(spark, rows):
    """(doc_id, text) rows with columns whose names the operators use themselves."""
    schema = "doc_id long, text string, h string, keep_id string, page long, kept string, score double"
    return spark.createDataFrame([(i, t, "x", "y", 1, "z", None) for i, t in rows], schema)


TEXTS = [
    (5, "a  b"), (3, "a\tb"), (9, "a b"), (4, "A b"), (1, None), (2, ""), (8, " "), (7, "\n\r "), (6, "word " * 30_000), (10, "word  " * 30_000),
    (3, "a b"), (3, "a b"), (None, "a b"), (None, "alone"), (None, "both"), (None, "both"), (11, "é ü"), (12, "é\x0bü"), (13, "a b"), (14, "a b "),
]


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANKS.sub(" ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        least = min((i for i in ids if i is not None), default=None)
        for i in ids:
            out[i, least, len(ids), i == least, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("digest", [F.md5, lambda t: F.lpad(F.hex(F.length(t) % 3), 2, "0")])
def test_exact_groups(spark, digest):
    """The second digest makes nearly all texts collide: bytes decide."""
    docs = docs_of(spark, TEXTS).repartition(3)
    assert Counter(map(tuple, exact.groups(docs, digest).collect())) == exact_by_hand(TEXTS)


def test_exact_large_group(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    got = exact.groups(docs_of(spark, rows))
    assert Counter(map(tuple, got.collect())) == exact_by_hand(rows)


def test_exact_empty_table(spark):
    assert exact.groups(docs_of(spark, [])).count() == 0 == exact.one_of_each(docs_of(spark, [])).count()


def test_exact_one_of_each(spark):
    docs = docs_of(spark, TEXTS)
    kept = exact.one_of_each(docs)
    assert kept.columns == docs.columns
    want = Counter((i, t) for i, t in TEXTS if exact_kept(i, t))
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def exact_kept(i, t):
    same = [j for j, u in TEXTS if BLANKS.sub(" ", u or "") == BLANKS.sub(" ", t or "")]
    return i == min((j for j in same if j is not None), default=None)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features_of(text):
    words = WORD.findall(lowered(text))
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)], len(words)


def resampled_by_hand(rows, target, percent, least, seed, buckets):
    """Counter of (doc_id, n_features, weight, score, rank, n_words)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    docs = [(i, *features_of(t)) for i, t in rows]
    s, t = Counter(bucket(f) for _, fs, _ in docs for f in fs), Counter(bucket(f) for x in target for f in features_of(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    scored = []
    for i, fs, n in docs:
        weight = sum(gain[bucket(f)] for f in fs)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        scored.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n))
    eligible = sorted((x for x in scored if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    most = percent * len(eligible) // 100
    out = [(*x[:4], r if r <= most else None, x[4]) for r, x in enumerate(eligible, 1)]
    return Counter(out + [(*x[:4], None, x[4]) for x in scored if x[4] < least])


def resample_rows():
    rng = np.random.default_rng(5)
    some = lambda n, of: " ".join(f"{'Wé' if rng.integers(9) == 0 else 'w'}{rng.integers(of)}" for _ in range(n))
    rows = [(i, some(int(rng.integers(1, 80)), 30)) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " -- !\x00"), (103, "One"), (104, "a" * 5000 + " b " + "c" * 200 + " d"), (None, some(40, 9)), (None, some(40, 9))]
    rows += [(200 + i, "same words again and " * 8) for i in range(9)] + [(7, rows[7][1]), (105, "x-y_z;1é2" * 50), (106, "tail word " * 400)]
    return rows, [some(30, 6), None, "", "tail word", "tail word"]


def test_resample(spark):
    rows, target = resample_rows()
    got = resample.resample(docs_of(spark, rows).repartition(3), docs_of(spark, [(1, t) for t in target]), percent=30, least_words=8, seed=7, buckets=97)
    assert Counter(map(tuple, got.collect())) == resampled_by_hand(rows, target, 30, 8, 7, 97)


def test_resample_production_parameters(spark):
    rows, target = resample_rows()
    docs = docs_of(spark, rows)
    got = resample.resample(docs, docs_of(spark, [(1, t) for t in target]))
    want = resampled_by_hand(rows, target, 5, 20, 42, 10_000)
    assert Counter(map(tuple, got.collect())) == want
    drawn = resample.drawn(docs, docs_of(spark, [(1, t) for t in target]))
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {x[0] for x in want if x[4] is not None}


def test_resample_empty_tables(spark):
    none, some = docs_of(spark, []), docs_of(spark, [(1, "a b c"), (2, "a b")])
    assert resample.resample(none, some).count() == 0 == resample.resample(none, none).count()
    assert Counter(map(tuple, resample.resample(some, none, least_words=1).collect())) == resampled_by_hand([(1, "a b c"), (2, "a b")], [], 5, 1, 42, 10_000)


def test_pieces_give_the_features_of_the_whole(monkeypatch):
    texts = [b"one two three", b"", b"x" * 100, b"a b c d e f " * 30, b"--", "é ü".encode() * 20]
    whole = Counter((int(d), int(b)) for doc, bucket, _ in resample.features(texts) for d, b in zip(doc, bucket))
    want = Counter((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in features_of(t.decode())[0])
    assert whole == want
    for piece in (1, 7, 50):
        monkeypatch.setattr(resample, "PIECE", piece)
        assert Counter((int(d), int(b)) for doc, bucket, _ in resample.features(texts) for d, b in zip(doc, bucket)) == want


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1000, 70_000])
def test_shifted_checksums_join(n):
    a, b = b"some words", bytes(range(256)) * (n // 256 + 1)
    joined = resample.shifted(np.array([zlib.crc32(a)], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(b[:n]))
    assert joined[0] == zlib.crc32(a + b[:n])


def mined_by_hand(rows, anchors, positives, negatives, low, high):
    rows = sorted({(i, label, tuple(v)) for i, label, v in rows if None not in (i, label, v)})
    score = lambda a, b: sum(x * y for x, y in zip(a[2], b[2]))
    out = Counter()
    for a in (r for r in rows if anchors(r[0])):
        other = [(-score(a, b), b[0], b[1]) for b in rows if b[0] != a[0] and len(b[2]) == len(a[2])]
        for p, positive in sorted((s, i) for s, i, label in other if label == a[1])[:positives]:
            band = sorted((s, i) for s, i, label in other if label != a[1] and low * -p <= 100 * -s <= high * -p)
            for rank, (n, negative) in enumerate(band[:negatives], 1):
                out[a[0], positive, rank, negative, -p, -n] += 1
    return out


def vectors(seed=11, n=260):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, 5)) * 40
    rows = [(i, int(rng.integers(3)), [int(x) for x in centers[rng.integers(9)] + rng.normal(size=5) * 9]) for i in range(n)]
    rows += [(1000 + i, i % 2, [30, 1, 0, 0, 2]) for i in range(40)] + [(1100 + i, 2, [0] * 5) for i in range(3)]  # one common vector
    rows += [(1200, None, [1] * 5), (1201, 1, None), (None, 1, [1] * 5), (1203, 1, []), (1204, 1, []), (1205, 2, []), (1206, 1, [3, 4]), (1207, 1, [3, 5]), (1208, 0, [3, 3]), (1209, 0, [-9, -9])]
    return rows + [rows[0], rows[5], (rows[10][0], 1, rows[11][2]), (1300, 7, [50] * 5)]


VECTORS = "vec_id long, label int, v array<long>, cell string, q string"


@pytest.mark.parametrize("block,cell", [(None, None), (40, 30), (25, 10**6)])
def test_hard_negatives(spark, block, cell):
    rows = vectors()
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS).repartition(3)
    got = hardneg.mine(table, F.col("vec_id") % 3 == 0, 4, 3, 50, 95, block, cell)
    want = mined_by_hand(rows, lambda i: i % 3 == 0, 4, 3, 50, 95)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100


def test_hard_negatives_empty_tables(spark):
    none = spark.createDataFrame([], VECTORS)
    assert hardneg.mine(none, F.lit(True)).count() == 0
    alone = spark.createDataFrame([(1, 1, [1, 2], "", ""), (2, 2, [1, 1], "", "")], VECTORS)
    assert hardneg.mine(alone, F.lit(True)).count() == 0 == hardneg.mine(alone, F.lit(False)).count()


@pytest.mark.parametrize("leaf", [2, 16])
def test_pairs_of_trees(monkeypatch, leaf):
    """The walk alone against all pairs, with small leaves; clusters let whole groups of queries go."""
    monkeypatch.setattr(hardneg, "LEAF", leaf)
    monkeypatch.setattr(hardneg, "HITS", 50)
    rng = np.random.default_rng(leaf)
    centers = rng.normal(size=(20, 4)) * 300
    x = np.floor(centers[rng.integers(20, size=900)] + rng.normal(size=(900, 4)) * 3)
    q = x[::9]
    lows, highs = np.full(len(q), -np.inf), np.where(np.arange(len(q)) % 2, np.inf, 0.9 * (q**2).sum(1))
    search = hardneg.Search(3, lows, highs, np.full(len(q), -1), [[i, i + 1000] for i in range(len(x))])
    search.walk(np.arange(len(q)), q, np.arange(len(x)), x)
    got = Counter(zip(*(a.tolist() for a in search.result())))
    scores = q @ x.T
    want = Counter((i, e, scores[i, e % 1000]) for i in range(len(q)) for _, e in sorted((-scores[i, j], e) for j in range(len(x)) if scores[i, j] <= highs[i] for e in (j, j + 1000))[:3])
    assert got == want
    assert leaf > 2 or search.pairs < 0.3 * 4 * len(q) * len(x) / leaf**2
