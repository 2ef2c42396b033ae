"""Vector codes, the prefix trie and fuzzy fingerprints against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from waymend.llm import along as al
from waymend.llm import fuzzy_prints as fp
from waymend.llm import prefix_trie as pt
from waymend.llm import vector_codes as vc
from pyspark.sql import functions as F

# Vector codes


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v and len(v) == 16 and all(x is not None and math.isfinite(x) and abs(x) < 65_536 for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = 16 // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[list(x[p]) for x in cut[:entries]] for p in range(parts)]

    def assign():
        found = []
        for x in cut:
            far = [[sum((a - b) ** 2 for a, b in zip(x[p], e)) for e in books[p]] for p in range(parts)]
            found.append([(min(f), f.index(min(f))) for f in far])
        return found

    for _ in range(rounds):
        places = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [x[p] for x, at in zip(cut, places) if at[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    rows = [(i, bytes(e for _, e in at), sum(d for d, _ in at), label) for (i, _, label), at in zip(kept, assign())]
    return rows, books


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(20)]
    rows = [(k * 7 % 401, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)], rng.choice([1, 1, 1, 2, None])) for k in range(300)]
    rows += [(900, None, 1), (901, [], 1), (902, [float("nan")] * 16, 2), (903, [1.0] * 15 + [None], 2), (904, [float("-inf")] + [0.0] * 15, 2), (905, [1.0] * 8, 2), (906, [1e30] + [0.0] * 15, 2)]
    rows += [rows[5]] * 40 + [(None, rows[6][1], None), (rows[7][0], rows[8][1], 3), (5000, [-0.00001] * 16, 7), (5001, [60_000.0, -60_000.0] * 8, 7)]
    return rows


SCHEMA = "vec_id long, embedding array<double>, label int, rid string, codes string, CODES int, kind map<string,int>, `a b` struct<`c d`:int>"


def test_codes_against_whole_rounds(spark, vectors):
    rows = spark.createDataFrame([(*r, "x", "y", 1, {"a": 1}, (1,)) for r in vectors], SCHEMA).repartition(5)
    coded, books = vc.vector_codes(rows)
    want, want_books = brute_codes(vectors)
    assert books.tolist() == want_books
    got = sorted(((r.vec_id, bytes(r.codes), r.error, r.label) for r in coded.collect()), key=str)
    assert got == sorted(want, key=str)
    sums = defaultdict(int)
    for _, _, error, label in want:
        sums[label] += error
    assert all(r.label_error == sums[r.label] for r in vc.with_label_errors(coded).collect())


def test_codes_of_few_and_no_vectors(spark):
    few = [(k, [float(k), -float(k)] * 8, None) for k in range(3)]
    coded, books = vc.vector_codes(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int"))
    assert books.shape == (8, 3, 2) and {r.vec_id: bytes(r.codes) for r in coded.collect()} == {k: bytes([k] * 8) for k in range(3)}
    coded, books = vc.vector_codes(spark.createDataFrame([(1, None, None)], "vec_id long, embedding array<double>, label int"))
    assert vc.with_label_errors(coded).collect() == [] and books.size == 0
    assert vc.codebooks_digest(books) == hashlib.sha256(b"").hexdigest()


def test_rounds_shuffle_no_vectors(spark, vectors):
    """The table of vectors and the assignments beside it are read without an exchange."""
    rows = spark.createDataFrame([r for r in vectors if r[1] and len(r[1]) == 16], "vec_id long, embedding array<double>, label int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        coded, _ = vc.vector_codes(rows)
        plan = coded._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in plan and "Exchange" not in plan


# Prefix trie


def brute_trie(rows, group=100, heads=6):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(hashlib.md5(role.encode()).hexdigest().encode() + text.encode()).hexdigest()
            turns[c].append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [(x[3], x[4]) for x in sorted(t)] for c, t in turns.items()}
    walks = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % heads
        walks[c] = turns.get(c - int(math.fmod(c, group)), [])[:h] + own[h:]
    members = defaultdict(list)
    for c, walk in walks.items():
        for d in range(len(walk) + 1):
            members[tuple(walk[:d])].append(c)
    found = []
    for node, inside in members.items():
        under = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(m[:-1] == n for m in members if m)
        ends = ",".join(str(c) for c in sorted(c for c in inside if len(walks[c]) == len(node)))
        found.append((
            min(inside), len(node), min(members[node[:-1]]) if node else None, len(inside), sum(1 for m in members if m and m[:-1] == node), sum(map(leaf, under)),
            sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return found


TURNS = "conv_id long, turn long, role string, text string, conv string, DEPTH int, level map<string,int>, `a b` struct<`c d`:int>"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(8)
    rows = []
    for c in [*range(100, 118), *range(200, 230, 2), 307, 309, -5, -3, 0, 99]:
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None, "ccc"])))
    rows += [(400, None, "user", "first"), (400, 1, "user", "x"), (400, 1, "user", "w"), (400, 1, "user", "x"), (None, 1, "user", "gone")]
    rows += [(500 + k, t, "user", f"same {t}") for k in range(30) for t in range(3)]
    rows += [(600, t, "user", f"long {t}") for t in range(120)]
    return rows


@pytest.mark.parametrize("shares,piece", [(5_000, 10_000), (1, 2), (20, 3)])
def test_trie(spark, talks, monkeypatch, shares, piece):
    monkeypatch.setattr(al, "SHARES", shares)
    monkeypatch.setattr(pt, "PIECE_IDS", piece)
    rows = spark.createDataFrame([(*r, "x", 1, {"a": 1}, (1,)) for r in talks], TURNS).repartition(7)
    got = [tuple(r) for r in pt.prefix_trie(rows).select(*NODE).collect()]
    assert sorted(got, key=str) == sorted(brute_trie(talks), key=str)


def test_trie_has_few_levels_and_keeps_plain_conversations(spark, talks):
    trie = pt.prefix_trie(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string"), heads=1)
    rows = trie.collect()
    assert sorted((tuple(r[c] for c in NODE) for r in rows), key=str) == sorted(brute_trie(talks, heads=1), key=str)
    n = len({c for c, *_ in talks if c is not None})
    assert max(r.level for r in rows) <= math.log2(n)
    heavy = defaultdict(int)
    for r in rows:
        heavy[r.parent_conv_id, r.depth] += r.heavy
    assert all(heavy[p, d] <= sum(1 for r in rows if (r.parent_conv_id, r.depth) == (p, d)) for p, d in heavy) and sum(r.heavy for r in rows) == sum(r.n_children > 0 for r in rows)


def test_trie_of_nothing(spark):
    assert pt.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert pt.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn long, role string, text string")).collect() == []


def test_running_values_cross_borders(spark):
    rows = spark.createDataFrame([(k % 3 if k < 40 else 7, k, k * k % 11) for k in range(400)], "g long, at long, v long").repartition(3)
    got = {(r.g, r.at): (r.total, r.most, r.x) for r in al.along(rows.repartition(9), ["g"], [F.col("at")], {"total": ("sum", "v"), "most": ("max", "v"), "x": ("bit_xor", "v")}).collect()}
    seen = defaultdict(lambda: (0, -1, 0))
    for k in range(400):
        g, v = k % 3 if k < 40 else 7, k * k % 11
        t, m, x = seen[g]
        seen[g] = (t + v, max(m, v), x ^ v)
        assert got[g, k] == seen[g]


# Fuzzy fingerprints


def brute_print(text):
    """One text alone, a byte at a time."""
    from waymend.llm.kernels import BYTE_VALUES, Prints, mixed

    data = text.encode()
    padded = np.frombuffer(bytes(fp.ROLL) + data, np.uint8)
    levels = []
    for k in range(len(data)):
        seven = padded[k + 1 : k + 1 + fp.ROLL]
        hashed = int(Prints(BYTE_VALUES[seven]).grams(fp.ROLL)[0])
        levels.append(64 if not hashed else (hashed & -hashed).bit_length() - 1)

    def pieces(level):
        found, start = [], 0
        for k, x in enumerate(levels):
            if x >= level:
                found.append((start, k + 1))
                start = k + 1
        return [*found, (start, len(data))] if start < len(data) else found

    level = max([x for x in range(fp.LEAST_LEVEL, fp.MOST_LEVEL + 1) if sum(y >= x for y in levels) >= fp.LEAST_PIECES], default=fp.LEAST_LEVEL)
    parts = []
    for step in range(fp.SIZES):
        cuts = pieces(level + step)
        if len(cuts) > fp.MOST_LETTERS:
            cuts = [*cuts[: fp.MOST_LETTERS - 1], (cuts[fp.MOST_LETTERS - 1][0], len(data))]
        marks = [Prints(mixed(BYTE_VALUES[np.frombuffer(data[a:b], np.uint8)] ^ np.uint64(0x5DEECE66D)), family=1).of(np.array([0]), np.array([b - a]))[0] for a, b in cuts]
        parts.append("".join(fp.LETTERS[int(m) >> 58] for m in marks))
    return f"{1 << level}:" + ":".join(parts)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    one = {(int(a.split(":")[0]) << k): s for k, s in enumerate(a.split(":")[1:])}
    two = {(int(b.split(":")[0]) << k): s for k, s in enumerate(b.split(":")[1:])}
    common = sorted(set(one) & set(two))
    if not common or not (one[common[0]] or two[common[0]]):
        return 0.0
    s, t = one[common[0]], two[common[0]]
    return 1 - distance(s, t) / max(len(s), len(t))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(12)
    rows = [(k, prose(rng, rng.choice([1, 3, 20, 60, 300]))) for k in range(0, 120, 2)]
    rows += [(1, None), (3, ""), (5, "a"), (7, "é" * 400), (9, "ab" * 5000), (None, "no id"), (None, None), (11, prose(rng, 6000))]
    rows += [(2, "same id, another text"), (13, rows[4][1]), *[rows[5]] * 30]
    return rows


def test_fingerprints_against_single_texts(texts):
    every = [(t or "").encode() for _, t in texts]
    assert fp.fingerprints_of(every) == [brute_print(t or "") for _, t in texts]
    rng = random.Random(1)
    marks = [brute_print(t or "") for _, t in texts]
    pairs = [(rng.choice(marks), rng.choice(marks)) for _ in range(300)]
    got = fp.likeness_of([a for a, _ in pairs], [b for _, b in pairs])
    assert np.allclose(got, [brute_likeness(a, b) for a, b in pairs])
    words = ["", "a", "abc", "abd", "x" * 64, "xy" * 32, "kitten", "sitting"]
    every = [(a, b) for a in words for b in words]
    assert fp.edit_distances([a for a, _ in every], [b for _, b in every]).tolist() == [distance(a, b) for a, b in every]


@pytest.mark.parametrize("parts", [1, 6])
def test_fuzzy_prints(spark, texts, parts):
    schema = "doc_id long, text string, part int, ROW string, role map<string,int>, `a b` struct<`c d`:int>"
    rows = spark.createDataFrame([(*r, 1, "x", {"a": 1}, (1,)) for r in texts], schema).repartition(parts)
    got = sorted((tuple(r) for r in fp.fuzzy_prints(rows).collect()), key=str)
    ordered = sorted(((i, t or "") for i, t in texts), key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    want = []
    for k, (i, t) in enumerate(ordered):
        after, h = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        edited = t[: len(t) - h] + after[:h]
        a, b, c = brute_print(t), brute_print(edited), brute_print(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c)))
    assert got == sorted(want, key=str)


def test_fuzzy_prints_of_one_and_none(spark):
    schema = "doc_id long, text string"
    assert fp.fuzzy_prints(spark.createDataFrame([], schema)).collect() == []
    (one,) = fp.fuzzy_prints(spark.createDataFrame([(4, "abcdef")], schema)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and one.near_next == 1.0


def test_halves_are_found_and_strangers_are_not(texts):
    rng = random.Random(3)
    long = [prose(rng, 250) for _ in range(200)]
    edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(long, long[1:])]
    marks, other = fp.fingerprints_of([t.encode() for t in long]), fp.fingerprints_of([t.encode() for t in edited])
    near, far = fp.likeness_of(marks[:-1], other), fp.likeness_of(marks[:-1], marks[1:])
    assert near.min() > 0.3 and far.max() < 0.25


def test_columns(spark):
    rows = spark.createDataFrame([("abc " * 50, None), ("abc " * 50, "x"), (None, "")], "a string, b string")
    marked = rows.select(fp.fingerprint(F.col("a")).alias("a"), F.when(F.col("b").isNotNull(), fp.fingerprint(F.col("b"))).alias("b"))
    got = [(r.a, r.b, r.n) for r in marked.withColumn("n", fp.likeness(F.col("a"), F.col("b"))).collect()]
    assert [n for *_, n in got] == [None, 0.0 if brute_likeness(got[1][0], got[1][1]) == 0 else brute_likeness(got[1][0], got[1][1]), 1.0]
