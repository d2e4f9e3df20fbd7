"""The operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bibliospark.llm import common, countmin, covertree, jaccard, language, licenses, mixing, mtree, pseudonyms, queries, substrings

DOCS = "doc_id long, text string, lang string, source string, n_chars long, path string, ids string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}" if (i or 0) % 4 else None, 0, "p", "q") for i, t in texts], schema)


def corpus_texts():
    rng = np.random.default_rng(3)
    base = [" ".join(f"w{rng.integers(40)}" for _ in range(rng.integers(1, 60))) for _ in range(25)]
    near = []
    for b in base[:12]:
        words = b.split()
        words[len(words) // 2] = "changed"
        near += [b, " ".join(words), b.upper(), b + " tail", "Lead " + b]
    texts = list(enumerate(base + near))
    return [*texts, (200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "ONE"), (205, "two words"), (206, "x y " * 20_000), (7, base[0]), (7, base[0]), (None, base[1]), (None, "alone and null")]


def components_of(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        up[root(a)] = root(b)
    return {n: root(n) for n in nodes}


def shingle_set(text, n):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, n, num):
    texts = corpus_texts()
    sets = [shingle_set(t, n) for _, t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
    roots = components_of(range(len(texts)), links)
    groups = defaultdict(list)
    for i, r in roots.items():
        groups[r].append(i)
    expected = Counter()
    for i, (doc, _) in enumerate(texts):
        ids = [texts[j][0] for j in groups[roots[i]] if texts[j][0] is not None]
        expected[doc, len(sets[i]), min(ids, default=None) if sets[i] else doc] += 1
    got = jaccard.near_duplicates(make(spark, texts), n, num, 100).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == expected
    assert sum(r.kept for r in got) == len({roots[i] for i in range(len(texts))})
    kept = jaccard.one_of_each(make(spark, texts), n, num, 100)
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert kept.count() == len({roots[i] for i in range(len(texts))})


def test_jaccard_empty_table(spark):
    assert jaccard.near_duplicates(make(spark, [])).collect() == []


def test_jaccard_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words = list(base)
        words[i % 120] = f"own{i}"
        texts.append((i, " ".join(words)))
    got = jaccard.near_duplicates(make(spark, texts), 3, 90, 100)
    assert {r.component_id for r in got.collect()} == {0}


def removed(texts, n):
    first = {}
    for doc, t in sorted((d, t or "") for d, t in texts if d is not None):
        w = WORDS.findall(t)
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), doc)
    out = Counter()
    for doc, t in texts:
        w = WORDS.findall(t or "")
        gone = set()
        for i in range(len(w) - n + 1):
            if doc is not None and first.get(tuple(w[i : i + n]), doc) < doc:
                gone.update(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[doc, len(w), len(gone), " ".join(kept)] += 1
    return out


@pytest.mark.parametrize("n,bits,size", [(13, 28, 3 << 20), (4, 16, 2000), (2, 16, 500)])
def test_substring_dedup(spark, n, bits, size):
    texts = corpus_texts()
    got = substrings.remove_repeats(make(spark, texts), n, bits, size).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.text) for r in got) == removed(texts, n)


def test_substring_dedup_empty_table(spark):
    assert substrings.remove_repeats(make(spark, [])).collect() == []


def test_count_min_never_underestimates():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    batch = countmin.counted(keys, keys[:100], 16)
    twice = {}
    for cell, blob in zip(batch["cell"].to_pylist(), batch["twice"].to_pylist()):
        twice[cell >> 20] = twice.get(cell >> 20, set()) | {(cell & (1 << 20) - 1) * (1 << 16) + x for x in common.unpacked_gaps(blob).tolist()}
    for row, at in enumerate(countmin.places(keys[:100], 16)):
        assert set(at.tolist()) <= twice[row]


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 3, 255, 510, 511], [1 << 20], list(range(0, 10**6, 7919)), [3, 1 << 40]])
def test_packed_gaps(values):
    assert common.unpacked_gaps(common.packed_gaps(np.array(values, np.int64))).tolist() == values


def test_word_hashes_agree_with_split():
    texts = [b"", b" a b\ta\n", b"A a", "é é".encode(), b"long " * 1000, b"ab", b"ba"]
    h, counts = common.word_hashes(texts, lower=True, most_bytes=64)
    words = [w.lower() for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts]
    assert len({(w, x) for w, x in zip(words, h.tolist())}) == len(set(words)) == len(set(h.tolist()))


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)]
    roots = components_of({n for e in links for n in e if e[0] != e[1]}, [e for e in links if e[0] != e[1]])
    least = defaultdict(lambda: 10**9)
    for n, r in roots.items():
        least[r] = min(least[r], n)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: least[r] for n, r in roots.items()}


def test_mixing(spark):
    texts = [(i, "w " * (i * 7 % 23)) for i in range(300)] + [(5, "again again"), (None, "x y"), (301, None)]
    docs = make(spark, texts).withColumn("source", F.when(F.col("doc_id") < 150, "big").otherwise(F.col("source")))
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(texts)
    sizes, targets, taken = Counter(), {}, Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
        assert r.taken <= 2 * r.size
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    share, free = {s: 0.0 for s in names}, set(names)
    rest = 1.5 * sum(sizes.values())
    while free:
        level = rest / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            share |= {s: level * weight[s] for s in free}
            break
        share |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(2.0 * sizes[s] for s in over)
        free -= over
    for s in names:
        assert targets[s] == pytest.approx(share[s])
        assert abs(taken[s] - targets[s]) <= 25
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in rows)
    assert mixing.mix(make(spark, [])).collect() == []


def test_thresholds_are_nested(spark):
    sizes = spark.createDataFrame([(i, "a" if i % 3 else None, i % 5) for i in range(200)], "doc_id long, source string, size long").withColumn("h", mixing.hash60(F.col("doc_id")))
    budgets = spark.createDataFrame([("a", 0, 20.0), ("a", 1, 60.0), (None, 0, 10.0), (None, 1, 9999.0)], "source string, budget_no int, budget double")
    t = {(r.source, r.budget_no): r.threshold for r in mixing.thresholds(sizes, budgets).collect()}
    rows = sizes.collect()
    for (source, no), bound in t.items():
        got = sum(r["size"] for r in rows if r.source == source and r.h < bound)
        want = min({("a", 0): 20, ("a", 1): 60, (None, 0): 10, (None, 1): 9999}[source, no], sum(r["size"] for r in rows if r.source == source))
        assert abs(got - want) <= 4
    assert t["a", 0] <= t["a", 1] and t[None, 0] <= t[None, 1]


def vectors():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(260):
        base = rng.normal(size=8)
        rows.append((i * 2, [float(x) for x in base], int(i % 3)))
        if i % 4 == 0:
            rows += [(1000 + i * 5 + k, [float(x) for x in base * (1 + k) + rng.normal(size=8) * 0.15], int(i % 3)) for k in range(4)]
    rows += [(3000 + i, [1.0] * 8, 1) for i in range(40)]
    rows += [(4000, None, 1), (4001, [0.0] * 8, 1), (4002, [float("nan")] + [1.0] * 7, 1), (4003, [None] + [1.0] * 7, 1), (4004, [1.0] * 8, None), (4050, [1.0] * 8, 1), (4051, [1.0, 2.0], 1), (4052, [], 1), (4100, [float("inf")] * 8, 1)]
    return rows


VEC = "vec_id long, embedding array<float>, label int, v string"


def test_cover_tree(spark):
    rows = [(*r, "x") for r in vectors()]
    raw = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab, _ in rows]
    good = {i: (np.array(e), lab) for i, e, lab in raw if e and lab is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.linalg.norm(good[a][0]) / np.linalg.norm(good[b][0]) >= 0.93]
    count = Counter(x for e in links for x in e)
    roots = components_of([r[0] for r in raw], links)
    least = {}
    for n, r in roots.items():
        least[r] = min(least.get(r, n), n)
    expected = sorted((n, count[n], least[roots[n]], n == least[roots[n]]) for n in roots)
    df = spark.createDataFrame(rows, VEC)
    for block, sent in ((2048, 16384), (32, 64)):
        assert sorted(map(tuple, covertree.near_duplicates(df, 0.93, block, sent).collect())) == expected
    assert covertree.near_duplicates(df.limit(0)).collect() == []


def test_cover_tree_pairs_of_a_large_leaf_come_once():
    x = np.concatenate([np.ones((500, 1)), np.random.default_rng(5).normal(size=(500, 7)) * 0.005], 1)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    assert (x @ x.T).min() > 0.999
    tree = covertree.CoverTree(x)
    pairs = [tuple(sorted(p)) for i, j in covertree.dual(tree, tree, 0.93) for p in zip(i.tolist(), j.tolist())]
    assert len(pairs) == 500 * 499 // 2 and len(set(pairs)) == len(pairs)


@pytest.mark.parametrize("block,query_block", [(8192, 2048), (50, 3)])
def test_m_tree(spark, block, query_block):
    rows = [(*r, "x") for r in vectors()]
    df = spark.createDataFrame(rows, VEC).select("vec_id", mtree.integers(F.col("embedding")).alias("v"))
    usable = {r[0]: np.floor(256 * np.float32(r[1]).astype(float)).astype(int) for r in rows if r[1] is not None and None not in r[1] and np.isfinite(r[1]).all()}
    expected = []
    for q in usable:
        if q % 50 == 0:
            best = sorted((-int(usable[q] @ usable[c]), c) for c in usable if c != q and len(usable[c]) == len(usable[q]))[:5]
            expected += [(q, i, c, -s) for i, (s, c) in enumerate(best, 1)]
    assert sorted(map(tuple, mtree.top_k(df, F.col("vec_id") % 50 == 0, 5, block, query_block).collect())) == sorted(expected)


def test_m_tree_prunes():
    rng = np.random.default_rng(1)
    x = (np.repeat(rng.normal(size=(20, 16)), 200, 0) * 400 + rng.normal(size=(4000, 16)) * 3).astype(int)
    tree = mtree.MTree(x)
    got = tree.search(x[17], 5, [[i] for i in range(len(x))], 17)
    assert got == sorted(((int(x[17] @ x[i]), i) for i in range(len(x)) if i != 17), key=lambda p: (-p[0], p[1]))[:5]
    assert tree.computed < len(x) / 2


def test_language_is_learned_and_held_out(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = queries.op5_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark):
    train = make(spark, [(i, "the and of to " * 5) for i in range(30)]).unionByName(make(spark, [(i, "der die und das " * 5) for i in range(100, 130)]).withColumn("lang", F.lit("de")))
    net = language.fit(train, per_language=20)
    odd = make(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "é"), (5, "the and of " * 30_000), (None, "der die das"), (5, "the and of " * 30_000)])
    got = language.identify(odd, net)
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    by = defaultdict(list)
    for r in got.collect():
        by[r.doc_id].append((r.lang_pred, r.score))
    assert by[1] == by[2] == by[3] == [("und", 0.0)] and by[5][0] == by[5][1] and by[5][0][0] == "en" and by[None][0][0] == "de"
    assert language.fit(odd.limit(0)) is None
    assert {r.lang_pred for r in language.identify(odd, None).collect()} == {"und"}


LICENSED = [(1, "Released under the MIT License. gnu GENERAL public-license"), (2, None), (3, ""), (4, "cc by cc by CC-BY!"), (5, "This work is licensed under the GNU General Public License, version 3 or so"),
            (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under the Apache License, Version 2.0 (the \"License\")"), (8, "apache licenses mit éapache license"), (9, "a " * 50_000 + "mit license"), (9, "mit license"), (None, "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version")]


def test_licenses(spark):
    out = licenses.scan_licenses(make(spark, LICENSED)).collect()
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    expected = Counter()
    for doc, t in LICENSED:
        w = word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        starts, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    starts.append(i)
                    labels.add(label)
        expected[doc, len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == expected
    labels = {r.doc_id: r.labels for r in out if r.doc_id not in (9,)}
    assert labels[1] == "gpl,mit,mit-notice" and labels[5] == "gpl,gpl-notice" and labels[6] == "cc-by,cc-by-nc-notice" and labels[7] == "apache,apache-2.0-notice" and labels[None] == "gpl,gpl-or-later"
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in out)
    assert licenses.scan_licenses(make(spark, [])).collect() == []


@pytest.mark.parametrize("text,accepted", [("a b d", True), ("a b c d", True), ("a x b d", False), ("a b v w e", False), ("z a b d z", True), ("a b c c d", False)])
def test_automaton_optional(text, accepted):
    a = licenses.Automaton("a b <<optional>> c <<end>> d")
    words = licenses.words_of(text.encode())
    assert any(a.longest(words, i) > 0 for i in range(len(words))) == accepted


def as_pattern(template):
    """The template as a regular expression over words that a blank precedes."""
    out = ""
    for mark, lo, hi, word in re.findall(r"<<(optional|end|var)(?: (\d+) (\d+))?>>|(\S+)", template):
        out += {"optional": "(?:", "end": ")?", "var": rf"(?: \S+){{{lo},{hi}}}", "": " " + re.escape(word)}[mark]
    return re.compile(out + r"(?= |$)")


def test_templates_against_regular_expressions():
    rng = np.random.default_rng(11)
    patterns = {label: as_pattern(t) for label, t in licenses.TEMPLATES.items()}
    scan = licenses.scanner(licenses.BASE, licenses.TEMPLATES)
    seen = set()
    for template in licenses.TEMPLATES.values():
        for _ in range(40):
            words, skip = [], False
            for mark, lo, hi, word in re.findall(r"<<(optional|end|var)(?: (\d+) (\d+))?>>|(\S+)", template):
                if mark == "optional":
                    skip = rng.random() < 0.5
                elif mark == "end":
                    skip = False
                elif not skip:
                    words += [word] if word else ["any"] * int(rng.integers(int(lo), int(hi) + 2))
            kind = rng.integers(4)
            if kind == 1:
                words[int(rng.integers(len(words)))] = "other"
            elif kind == 2:
                del words[int(rng.integers(len(words)))]
            words = ["x"] * int(rng.integers(3)) + words + ["y"] * int(rng.integers(3))
            text = " ".join(words)
            labels = {label for label, p in patterns.items() if p.search(" " + text)}
            assert scan(text.encode())[3] - scan(text.encode())[2] == labels, text
            seen |= labels
    assert seen == set(patterns)


def test_many_hits_take_time_in_proportion():
    import time

    scan, begin = licenses.scanner(licenses.BASE, licenses.TEMPLATES), time.process_time()
    assert len(scan(b"mit license " * 80_000)[1]) == 80_000 and time.process_time() - begin < 5


def test_automaton_replaceable():
    a = licenses.Automaton("to <<var 1 2>> without limit")
    assert a.longest(b"to one without limit".split(), 0) == 4 and a.longest(b"to one two without limit".split(), 0) == 5
    assert a.longest(b"to without limit".split(), 0) == -1 and a.longest(b"to a b c without limit".split(), 0) == -1


def shifted(text, key, kind):
    half = len(text) // 2
    left, right = text[:half], text[half:]

    def move(s, turn, other):
        h = hashlib.sha256(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(s):
            k = int(h[i % 32 * 2 : i % 32 * 2 + 2], 16)
            first, n = (48, 10) if c.isdigit() else (97, 26) if c.islower() else (65, 26)
            out += chr((ord(c) - first + k) % n + first)
        return out

    for turn in range(pseudonyms.ROUNDS):
        left, right = (move(left, turn, right), right) if turn % 2 == 0 else (left, move(right, turn, left))
    return left + right


def luhn(digits):
    return sum(d * 2 - 9 * (d * 2 > 9) if i % 2 else d for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def test_pseudonyms_against_python(spark):
    values = ["0", "12", "555123", "aZ9", "abcdefghijklmnopqrstuvwxyz0123456789" * 2]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", pseudonyms.permuted_text(F.col("v"), "k", "card").alias("p"))
    assert {r.v: r.p for r in df.collect()} == {v: shifted(v, "k", "card") for v in values}


def test_permutations_are_one_to_one(spark):
    df = spark.range(0, 21 * 13).select(pseudonyms.permuted_number(F.col("id"), 21, 13, "k", "t").alias("n"), pseudonyms.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("t"))
    rows = df.collect()
    assert sorted(r.n for r in rows) == list(range(21 * 13)) and len({r.t for r in rows}) == 21 * 13


def test_pseudonyms_in_texts(spark):
    texts = [(1, "pay 4111 1111 1111 1111 or 4111-1111-1111-1111, not 4111111111111112"), (2, "mail el.01@mail8.example.com, ip 169.122.221.182!"), (3, "+1 (988) 555-2485 and 2020-02-29 and 2021-02-29"), (4, None), (5, ""), (6, "x " * 100_000 + "4111111111111111"),
             (6, "again 4111111111111111"), (None, "GB29 NWBK 6016 1331 9268 19 078-05-1120 000-12-1234 300.1.1.1 1.2.3.4.5")]
    out = {}
    for r in pseudonyms.pseudonymise(make(spark, texts), "key").collect():
        out.setdefault(r.doc_id, []).append(r)
    cards = re.findall(r"\d{4}.\d{4}.\d{4}.\d{4}", out[1][0].text)
    assert len(cards) == 2 and re.sub(r"\D", "", cards[0]) == re.sub(r"\D", "", cards[1]) and luhn(re.sub(r"\D", "", cards[0])) and "4111111111111112" in out[1][0].text and "4111 1111" not in out[1][0].text
    assert re.sub(r"\D", "", cards[0]) in out[6][0].text.replace(" ", "") and re.sub(r"\D", "", cards[0]) in out[6][1].text
    assert re.fullmatch(r"mail [a-z]{2}\.\d\d@mail8\.example\.com, ip (\d{1,3}\.){3}\d{1,3}!", out[2][0].text) and "el.01" not in out[2][0].text and "169.122.221.182" not in out[2][0].text
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{4}-\d\d-\d\d and 2021-02-29", out[3][0].text) and "2020-02-29" not in out[3][0].text
    assert out[4][0].text is None and out[5][0].text == "" and [len(r.pii_found) for r in out[None]] == [2]
    assert "000-12-1234 300.1.1.1 1.2.3.4.5" in out[None][0].text
    assert pseudonyms.pseudonymise(make(spark, []), "key").collect() == []


@pytest.mark.parametrize("text,value,rest", [
    ("4111 1111 1111 1111 12/25", r"(\d{4} ){3}\d{4}", "@ 12/25"), ("4111111111111111 123", r"\d{16}", "@ 123"), ("12 4111 1111 1111 1111", r"(\d{4} ){3}\d{4}", "12 @"),
    ("1234 4111 1111 1111 1111 x", r"(\d{4} ){3}\d{4}", "1234 @ x"), ("4111 1111 1111 1111 12.3.2024", r"(\d{4} ){3}\d{4}", None), ("4111 1111 1111 1111 2020-02-29", r"(\d{4} ){3}\d{4}", None),
    ("ES91 2100 0418 4502 0005 1332 BIC", r"ES\d\d( \d{4}){5}", "@ BIC"), ("ES9121000418450200051332 CODE A", r"ES\d{22}", "@ CODE A"),
    ("+1 (988) 555-2485 12", r"\+1 \(\d{3}\) \d{3}-\d{4}", "@ 12"), ("+1 (988) 555-2485 4111 1111 1111 1111", r"(\d{4} ){3}\d{4}", None)])
def test_pseudonyms_of_values_beside_numbers_and_words(spark, text, value, rest):
    alone = {"4": "4111 1111 1111 1111", "E": "ES91 2100 0418 4502 0005 1332", "+": "+1 (988) 555-2485"}
    out, *same = pseudonyms.pseudonymise(make(spark, [(0, text), *enumerate(alone.values(), 1)]), "key").orderBy("doc_id").collect()
    found = [re.sub(r"\W", "", v.pseudonym) for v in out.pii_found]
    kinds = {"4": same[0], "E": same[1], "+": same[2]}
    held = "4" if "4111" in text else text[0]
    assert re.sub(r"\W", "", kinds[held].pii_found[0].pseudonym) in found and re.sub(r"\W", "", alone[held]) not in re.sub(r"\W", "", out.text)
    assert rest is None and len(found) == 2 or out.text in [rest.replace("@", v.pseudonym) for v in out.pii_found] and re.search(value, out.text)


@pytest.mark.parametrize("forms", [("+4930123456", "+49 30 123456", "+49-30-123456"), ("+12125550123", "+1 (212) 555-0123", "(212) 555-0123", "212.555.0123"), ("John@x.com", "john@x.com", "JOHN@X.COM"), ("AT61 1904 3002 3457 3201", "AT611904300234573201", "at61 1904 3002 3457 3201")])
def test_equal_values_stay_linked(spark, forms):
    rows = pseudonyms.pseudonymise(make(spark, [(i, f"x {f} EUR 500") for i, f in enumerate(forms)]), "key").orderBy("doc_id").collect()
    new = [r.pii_found[0].pseudonym for r in rows]
    plain = {re.sub(r"[^a-z0-9@]", "", v.lower())[-10 if forms[0] == "+12125550123" else 0 :] for v in new}
    assert len(plain) == 1 and all(n.lower() != f.lower() for n, f in zip(new, forms))
    assert [re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", n))) for n in new] == [re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", f))) for f in forms]
    assert [r.text for r in rows] == [f"x {n} EUR 500" for n in new] and (forms[0][:3] != "+49" or all(n.startswith("+49") for n in new))


def test_clashing_columns(spark):
    rows = [(1, "mail a.b@x.com, the cat sat on the mat", "en", "s", 7, 8, 9, 10, 11, 12, 13), (2, None, None, None, 7, 8, 9, 10, 11, 12, 13), (1, "mail a.b@x.com, the cat sat on the mat", "en", "s", 7, 8, 9, 10, 11, 12, 13)]
    names = ["_key", "_maybe", "_gone", "_copies", "_copy", "_candidates", "_text"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} int" for n in names))
    assert jaccard.one_of_each(docs).columns == docs.columns and sorted(r.doc_id for r in jaccard.one_of_each(docs).collect()) == [1, 2]
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and {r._copy for r in mixed.collect()} <= {11}
    assert [r._candidates for r in pseudonyms.pseudonymise(docs.withColumn("pii_found", F.lit(1)), "k").collect()] == [12] * 3
    found = language.identify(docs.withColumn("score", F.lit("old")), None).collect()
    assert [(r.lang_pred, r.score, r._text) for r in found] == [("und", 0.0, 13)] * 3


def test_network_against_loops():
    net = language.ByteConvNet(["a", "b", "c"], seed=3)
    windows = np.random.default_rng(4).integers(0, 256, (3, 20)).astype(np.uint8)
    slow = []
    for w in windows:
        h = [max(0.0, max(sum(float(t[i][w[at + i]][f]) for i in range(len(t))) for at in range(len(w) - len(t) + 1)) + float(b[f])) for t, b in zip(net.tables, net.bias) for f in range(language.FILTERS)]
        z = [sum(x * float(net.out[i][k]) for i, x in enumerate(h)) + float(net.out_bias[k]) for k in range(3)]
        top = max(z)
        slow.append([v - top - np.log(sum(np.exp(u - top) for u in z)) for v in z])
    assert np.allclose(net.log_probabilities(windows), slow, atol=1e-4)
    net.freeze()
    assert np.allclose(net.log_probabilities(windows), slow, atol=1e-4)


def test_op2_changes_only_what_it_found(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.op2_pseudonyms(spark, sf_dir).collect():
        assert len(r.text) - len(docs[r.doc_id]) in range(-40, 41) and (r.n_found > 0) == (r.text != docs[r.doc_id])
        assert not set(re.findall(r"[\w.]+@[\w.]+\.com", docs[r.doc_id])) & set(re.findall(r"[\w.]+@[\w.]+\.com", r.text))


def test_runs_of_numbers_take_little_time(spark):
    """Two-digit numbers in a row, 36 KB: seconds, not minutes, as nothing is made for runs that are no cards."""
    rng = np.random.default_rng(2)
    text = " ".join(str(x) for x in rng.integers(10, 100, 12_000))
    one = spark.createDataFrame([(1, "4111 1111 1111 1111 12")], "doc_id long, text string")
    pseudonyms.pseudonymise(one, "k").collect()
    began = time.time()
    row = pseudonyms.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k").first()
    assert time.time() - began < 60 and len(row.text) == len(text) and len(row.pii_found) > 500


def test_different_dates_stay_different(spark):
    """All days of the cycle in the forms that can write them: no pseudonym twice, the order of day and month kept."""
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("d"))
    late = days.where(F.dayofmonth("d") > 12)
    forms = days.select(F.date_format("d", "dd/MM/yyyy").alias("old")).union(late.select(F.date_format("d", "MM/dd/yyyy")))
    made = forms.repartition(4).select("old", pseudonyms._date(F.col("old"), "k").alias("new"))
    early = lambda c: F.substring(c, 4, 2).cast("int") <= 12
    valid = F.coalesce(F.try_to_date("new", "dd/MM/yyyy"), F.try_to_date("new", "MM/dd/yyyy")).isNotNull()
    n, distinct, same, right = made.agg(F.count("*"), F.count_distinct("new"), F.count_if(early("old") == early("new")), F.count_if(valid)).first()
    assert n == distinct == same == right == 146_097 + 146_097 - 12 * 4800
