"""Each operator against brute force on rows with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from waymend.llm import decontaminate as dc
from waymend.llm import kernels, licenses, line_dedup, minhash, mixing, quality, sharding, substring_dedup, suffix_dedup, toxicity
from waymend.llm.fmindex import FMIndex

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_hash string, spans string, n_words string, shard string, size string, label string"
WORDS = [a + b for a in ("ba", "ko", "li", "mé", "nu", "PA", "ro", "su", "ti", "wo") for b in ("n", "r", "s", "ß", "t", "l")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    passage, line = sentence(rng, 60), sentence(rng, 12)
    texts = [None, "", "   \n\t ", "one", "a\n\n\nb", "x " * 300, "\n".join([line] * 3 + [sentence(rng, 9)])]
    for k in range(12):
        body = [sentence(rng, 40)]
        if k % 2:
            body.append(passage)
        if k % 3 == 0:
            body.append(f"  {line.upper() if k % 2 else line}\t")
        texts.append("\n".join(body + [sentence(rng, 20)]))
    base = sentence(rng, 120).split()
    for k in range(6):
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(120)] = rng.choice(WORDS)
        texts.append(" ".join(copy))
    texts.append(sentence(rng, 4000))
    texts.append(texts[-1][200:9000])
    rows = [(k * 3 % 101, t, "en", None if k % 5 == 0 else f"s{k % 4}", k) for k, t in enumerate(texts)]
    rows.append(rows[9])
    rows.append((rows[8][0], "the same id with another text", "en", "s1", 1))
    rows.append((None, texts[11], "en", "s2", 1))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash", "clash", "clash") for r in corpus], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def bag(rows):
    return Counter(tuple(tuple(x.items()) if isinstance(x, dict) else x for x in r) for r in rows)


def covered(sequences, window):
    places = Counter()
    for s in sequences:
        for i in range(len(s) - window + 1):
            places[tuple(s[i : i + window]) if isinstance(s, list) else s[i : i + window]] += 1
    for s in sequences:
        gone = [False] * len(s)
        for i in range(len(s) - window + 1):
            if places[tuple(s[i : i + window]) if isinstance(s, list) else s[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        yield gone


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("hot,block", [(16_384, 1 << 20), (1, 1 << 20), (0, 300), (16_384, 300)])
def test_substring_dedup(docs, corpus, hot, block):
    rule = replace(substring_dedup.RULE, hot=hot, block_bytes=block)
    got = substring_dedup.substring_dedup(docs, rule=rule).select("doc_id", "n_words", "n_removed", "kept_text").collect()
    lists = [words(r[1]) for r in corpus]
    want = [(r[0], len(w), sum(g), " ".join(x for x, y in zip(w, g) if not y)) for r, w, g in zip(corpus, lists, covered(lists, 35))]
    assert bag(got) == bag(want)


@pytest.mark.parametrize("hot", [16_384, 1, 0])
def test_suffix_dedup(docs, corpus, hot):
    got = suffix_dedup.suffix_dedup(docs, rule=replace(suffix_dedup.RULE, window=120, gram=24, hot=hot)).collect()
    data = [(r[1] or "").encode() for r in corpus]
    want = [(r[0], len(b), sum(g), bytes(x for x, y in zip(b, g) if not y)) for r, b, g in zip(corpus, data, covered(data, 120))]
    assert bag((r.doc_id, r.n_bytes, r.n_removed, bytes(r.kept)) for r in got) == bag(want)
    for r in got:
        assert r.n_removed == sum(s.stop - s.start for s in r.removed) and all(a.stop < b.start for a, b in zip(r.removed, r.removed[1:]))


def test_repeated_rows_null_ids_and_a_long_text(spark):
    """1,000 rows of one id and text, 300 texts without an id, a text of 3 MB with a passage of another one."""
    rng = random.Random(31)
    passage, long_text = sentence(rng, 50), sentence(rng, 900_000)
    rows = [(1, sentence(rng, 45))] * 1000
    rows += [(None, f"{sentence(rng, 30)} {passage if k < 2 else sentence(rng, 30)}") for k in range(300)]
    rows += [(2, long_text), (3, " ".join(long_text.split()[500_000:500_060]))]
    assert len(long_text) > 3_000_000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = bag((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(docs).collect())
    assert got == Counter({(1, 45, 45): 1000, (None, 80, 50): 2, (None, 60, 0): 298, (2, 900_000, 60): 1, (3, 60, 60): 1})
    size = {1: len(rows[0][1].encode()), None: len(passage.encode()), 3: len(rows[-1][1].encode())}
    removed = Counter((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup(docs, rule=replace(suffix_dedup.RULE, window=150)).collect())
    assert removed[1, size[1]] == 1000 and removed[3, size[3]] == 1 and removed[None, 0] == 298
    # The passage and perhaps the blank before it; the long text's copy and what stands around it by chance.
    assert all(k[1] in (0, size.get(k[0], 0), size.get(k[0], 0) + 1) or (k[0] == 2 and size[3] <= k[1] <= size[3] + 2) for k in removed)


def test_long_words_are_told_apart():
    """A Thue-Morse word and its complement: no base tells them apart modulo 2**64."""
    word = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    text = f"{word} {word.translate(str.maketrans('ab', 'ba'))} {word}".encode()
    values = np.frombuffer(text, np.uint8)
    prints = kernels.Words(values, np.array([0, len(values)])).prints()
    assert prints[0] != prints[1] and prints[0] == prints[2]


def test_equal_windows_against_brute_force():
    rng = np.random.default_rng(7)
    for window in (3, 8, 13, 40):
        values = rng.integers(0, 2, 900).astype(np.uint8)
        values[500:600] = values[100:200]
        starts, group = np.arange(len(values) - window), rng.integers(0, 2, len(values) - window)
        seen = Counter((int(g), values[s : s + window].tobytes()) for s, g in zip(starts, group))
        want = [seen[int(g), values[s : s + window].tobytes()] > 1 for s, g in zip(starts, group)]
        assert suffix_dedup.equal_windows(values, starts, group, window).tolist() == want


def test_fm_index_by_hand():
    rng = np.random.default_rng(1)
    text = np.concatenate([np.append(rng.integers(1, 4, n), 0) for n in (9, 1, 14, 5)])
    index = FMIndex(text, 16, every=3)
    patterns, lengths = np.array([[1, 2, 0], [3, 0, 0], [2, 2, 1]]), np.array([2, 1, 3])
    for p, n, a, b in zip(patterns, lengths, *index.search(patterns, lengths)):
        want = [i for i in range(len(text) - n + 1) if (text[i : i + n] == p[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def shingles(text, size):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def components(ids, links):
    root = {i: i for i in ids}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size,broadcast,block", [(2, 10_000, 300_000), (5, 0, 300)])
def test_near_duplicates(docs, corpus, monkeypatch, size, broadcast, block):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", broadcast)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    got = minhash.near_duplicates(docs, shingle=size).collect()
    sets = [(r[0], shingles(r[1], size)) for r in corpus]
    links = [(a, b) for a, s in sets for b, t in sets if None not in (a, b) and a < b and s and t and 100 * len(s & t) >= 80 * len(s | t)]
    found = components({i for i, _ in sets if i is not None}, links)
    assert bag(got) == bag((i, len(s), found.get(i)) for i, s in sets)


def test_near_duplicates_need_the_second_round(spark):
    """A chain of copies, each one near the next only."""
    rng = random.Random(3)
    now, rows = [f"w{k}" for k in range(200)], []
    for k in range(25):
        rows.append((k, " ".join(now)))
        for _ in range(6):
            now[rng.randrange(200)] = f"x{rng.random()}"
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).collect()
    sets = [(i, shingles(t, 2)) for i, t in rows]
    links = [(a, b) for a, s in sets for b, t in sets if a < b and 100 * len(s & t) >= 80 * len(s | t)]
    assert {r.doc_id: r.component_id for r in found} == components(range(25), links)


@pytest.mark.parametrize("block,seekers,hot", [(300_000, 1000, 5000), (200, 3, 2)])
def test_links_between_components(spark, monkeypatch, block, seekers, hot):
    """The second round by itself, every set a component at first, two groups and one set alone: each linked pair is joined, and no other."""
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(minhash, "TASK_SEEKERS", seekers)
    monkeypatch.setattr(minhash, "HOT_PART", hot)
    rng = random.Random(5)
    rows = []
    for k in range(60):
        # Around ten stems, each with as many words changed as leaves some pairs just linked and others just not.
        stem = [f"s{k % 10}-{j}" for j in range(20 + k % 10)] + [f"all{j}" for j in range(30)]
        for _ in range(rng.randrange(5)):
            stem[rng.randrange(len(stem))] = f"x{rng.random()}"
        rows.append((k, " ".join(stem)))
    texts = spark.createDataFrame(rows, "id long, text string")
    sets = {i: shingles(t, 1) for i, t in rows}
    heads = spark.createDataFrame([(i, len(s)) for i, s in sets.items()], "id long, n_shingles long")
    group = {i: 0 if i % 10 < 7 else 7 for i in sets if i != 59}
    place = spark.createDataFrame(list(group.items()), "id long, place long")
    nodes = spark.createDataFrame([], "node long, component long")
    found = [(r.a, r.b) for r in minhash._between(heads, place, nodes, texts, "bigint", 1, 80).collect()]
    links = [(a, b) for a in group for b in group if a < b and group[a] == group[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links and {tuple(sorted(x)) for x in found} <= set(links)
    assert components(group, found) == components(group, links)


def test_unlinked_look_alikes_grow_linearly(spark, monkeypatch):
    """Documents of one candidate group that share most of a form, but not enough of it: the rows written for them follow their number, and none is compared."""

    def written(n):
        rows, compared, cut = [], [], minhash.cut

        def counting(df):
            found = cut(df)
            rows.append(found.count())
            if found.columns == ["id", "unit", "place", "label", "seeks", "n", "keys", "step"]:
                compared.append(rows[-1])
            return found

        with monkeypatch.context() as patch:
            patch.setattr(minhash, "cut", counting)
            texts = spark.range(n).selectExpr("id", "concat_ws(' ', transform(sequence(0, 23), j -> concat('form', j)), transform(sequence(0, 7), j -> concat(id, '-', j))) AS text")
            heads, place = texts.selectExpr("id", "32L AS n_shingles"), texts.selectExpr("id", "0L AS place")
            assert minhash._between(heads, place, spark.createDataFrame([], "node long, component long"), texts, "bigint", 1, 80).isEmpty()
        assert compared == [0]
        return sum(rows)

    assert written(20_000) <= 4.5 * written(5_000)


def test_second_round_deals_out_rare_prints_only(spark, monkeypatch):
    """Look-alikes whose every print stands in several sets: of 50 prints each, what is joined are the 11 that no link can all miss, also where counters are few."""
    n, dealt, meeting = 200, [], minhash._meeting

    def counting(tokens):
        dealt.append(tokens.count())
        return meeting(tokens)

    # 30 prints of all, 20 of which neighbours among ten share 13: at most 0.75 alike, but sets 0 and 1 are linked.
    rows = [(k, " ".join([f"all{j}" for j in range(30)] + [f"p{(k // 10)}-{(k % 10 * 7 + j) % 70}" for j in range(20)])) for k in range(n)]
    rows[1] = (1, rows[0][1].replace("p0-0 ", "own "))
    texts = spark.createDataFrame(rows, "id long, text string")
    heads, place = texts.selectExpr("id", "50L AS n_shingles"), texts.selectExpr("id", "0L AS place")
    sets = {i: shingles(t, 1) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    monkeypatch.setattr(minhash, "_meeting", counting)
    for slots in (minhash.SLOTS, 4):
        monkeypatch.setattr(minhash, "SLOTS", slots)
        dealt.clear()
        found = minhash._between(heads, place, spark.createDataFrame([], "node long, component long"), texts, "bigint", 1, 80).collect()
        assert {tuple(sorted((r.a, r.b))) for r in found} == set(links) == {(0, 1)}
        assert 0 < sum(dealt) <= 11 * n


def test_components_of_links(spark):
    """On the first path a node has two smaller neighbours after a round, with no node that both has one and is one."""
    rng = random.Random(8)
    paths = [[1, 4, 3, 5, 2], *(rng.sample(range(10 * k, 10 * k + 8), 8) for k in range(1, 60))]
    for some in (paths[:1], paths):
        links = [(a, b) for p in some for a, b in zip(p, p[1:])]
        found = minhash.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
        assert bag(found) == bag((a, min(p)) for p in some for a in p)


def test_near_duplicates_of_string_ids(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "other words altogether here now")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == {"a": "a", "b": "a", "c": "c"}


@pytest.mark.parametrize("batches", [1, 4])
def test_line_dedup(docs, corpus, batches):
    got = line_dedup.line_dedup(docs, least_chars=20, least_docs=3, batches=batches).collect()

    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))

    holders = {}
    for r in corpus:
        for k in {key(x) for x in (r[1] or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, set()).add(r[0])
    last = {k: max(i for i in ids if i is not None) for k, ids in holders.items() if len(ids) >= 3 and ids != {None}}
    want = []
    for r in corpus:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == r[0]]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    assert bag(got) == bag(want) and any(w[2] for w in want)


@pytest.mark.parametrize("batches", [1, 3])
def test_line_dedup_counts_documents_of_any_id_type(spark, batches):
    """A line in five rows of one id and one of another is in two documents; string ids come in batches too."""
    line, other = "a line that stands in some documents", "another line, found in four documents"
    rows = [("b", line)] * 5 + [("a", line)] + [(i, f"head\n {other.upper()}\t\n{other}\n") for i in ("c", "e", "d", "é")] + [(None, line), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = line_dedup.line_dedup(docs, least_chars=20, least_docs=4, batches=batches).collect()
    want = [(i, 1, 0, t) for i, t in rows[:6]] + [(i, 4, 2, "head\n") for i in ("c", "e", "d")] + [("é", 4, 0, rows[9][1]), (None, 1, 0, line), (None, 1, 0, "")]
    assert bag(got) == bag(want)
    runs = line_dedup.LineRuns(2)
    for k in range(5):
        runs.add(spark.createDataFrame([(f"d{9 - k}", f"l{j}".encode()) for j in range(k, k + 3)], "id string, line binary"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {bytes(r.line): (r.n_docs, r.last_id) for r in runs.counts().collect()} == {f"l{j}".encode(): (min(j, 4) - max(0, j - 2) + 1, f"d{9 - max(0, j - 2)}") for j in range(7)}


def test_runs_are_read_without_an_exchange(spark):
    """A batch beside all runs, and runs beside each other: merge joins of what lies in buckets already."""
    runs = line_dedup.LineRuns(9, buckets=3)
    for k in range(3):
        runs.add(spark.createDataFrame([(9 - k, f"l{j}".encode()) for j in range(k, k + 3)], "id long, line binary"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = line_dedup.bucketed(spark.createDataFrame([(b"l1", 1, 3), (b"new", 1, 3)], "line binary, n_docs long, last_id long"), "line", 3)
        for df in (runs.marked(own), runs.counts()):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert {bytes(r.line): r.last_id for r in runs.marked(own).collect()} == {b"l1": None, b"new": 3}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_runs_outlive_a_call(spark, corpus, tmp_path):
    """Documents of larger ids first, then the others against the stored runs, taken up by their paths: as all at once."""
    rows = [r for r in corpus if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = bag(line_dedup.line_dedup(docs, least_chars=5, least_docs=3).collect())
    runs = line_dedup.LineRuns(2, 4, str(tmp_path))
    placed = {part: line_dedup.line_places(docs.where(part), least_chars=5) for part in ("doc_id >= 60", "doc_id < 60 AND doc_id >= 20", "doc_id < 20")}
    for lines in placed.values():
        line_dedup.add_lines(runs, lines)
        runs = line_dedup.LineRuns.resumed(spark, runs.state(), "bigint", 4, 2, str(tmp_path))
    assert all(path.startswith(str(tmp_path)) for _, path in runs.state()) and [len(x) for x in runs.levels] == [1, 1]
    got = line_dedup.drop_lines(docs, line_dedup.line_places(docs, least_chars=5), runs, least_docs=3)
    assert bag(got.collect()) == want
    # Documents of smaller ids against the runs of the larger ones.
    first = line_dedup.LineRuns(2, 4, str(tmp_path))
    line_dedup.add_lines(first, placed["doc_id >= 60"])
    late = docs.where("doc_id < 60")
    assert bag(line_dedup.line_dedup(late, least_chars=5, least_docs=3, runs=first).collect()) == Counter({r: n for r, n in want.items() if r[0] < 60})


def test_line_dedup_of_a_long_text(spark):
    """200,000 lines, every second one dropped."""
    rng = random.Random(2)
    many = [f"line number {k} of a very long text, {rng.random()}" for k in range(100_000)]
    rows = [(1, "\n".join(x for k, line in enumerate(many) for x in (line, f"own {k}"))), *((k, "\n".join(many)) for k in (2, 3))]
    got = {r.doc_id: r for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), least_docs=3).collect()}
    assert got[1].n_lines == 200_000 and got[1].n_dropped == 100_000 and got[1].kept_text == "\n".join(f"own {k}" for k in range(100_000))
    assert got[2].kept_text == "" and got[3].kept_text == rows[2][1]


def test_quality_counts_and_verdicts(spark, docs, corpus):
    got = quality.quality_rules(docs, None).collect()
    want = []
    for r in corpus:
        w, text = words(r[1]), r[1] or ""
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in text.split("\n") if r[1] is not None else []:
            dup += bool(words(line)) and line in seen
            seen.add(line)
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        want.append((r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), failed, not failed))
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got) == bag(want)
    assert {c: r for r in got for c in ("lang", "spans")}["spans"].spans == "clash"


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    field = quality.Field(rng.normal(size=3), rng.normal(size=(2, 2)), rng.normal(size=2))
    features, bounds = rng.normal(size=(9, 3)), np.array([0, 4, 4, 5, 9])
    got = field.decode(features, bounds)
    for a, b in zip(bounds[:-1], bounds[1:]):
        best, path = -math.inf, None
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            score = sum((features[a + k] @ field.weights) * y[k] + (field.begins[y[k]] if k == 0 else field.steps[y[k - 1], y[k]]) for k in range(b - a))
            if score > best:
                best, path = score, y
        assert [not y for y in path or []] == got[a:b].tolist()


def test_field_is_the_most_likely_one():
    """Against the likelihood summed over all label sequences: no small step in any direction makes it larger."""
    rng = np.random.default_rng(11)
    n = np.array([1, 4, 2, 3, 4, 2])
    bounds = np.concatenate([[0], np.cumsum(n)])
    features, labels = rng.normal(size=(bounds[-1], 2)), rng.integers(0, 2, bounds[-1])
    decay = 0.05
    field = quality.fit_field(features, labels, bounds, rounds=4000, rate=0.02, decay=decay)
    best = np.concatenate([field.weights, field.steps.ravel(), field.begins])

    def likelihood(theta):
        w, s, b = theta[:2], theta[2:6].reshape(2, 2), theta[6:]
        total = 0.0
        for a, z in zip(bounds[:-1], bounds[1:]):
            score = lambda y: b[y[0]] + sum(features[a + k] @ w * y[k] for k in range(z - a)) + sum(s[y[k - 1], y[k]] for k in range(1, z - a))
            every = [score([c >> k & 1 for k in range(z - a)]) for c in range(2 ** (z - a))]
            total += score(labels[a:z].tolist()) - np.log(np.sum(np.exp(every)))
        return total / len(n) - decay * (theta**2).sum() / 2

    for k in range(8):
        step = np.eye(8)[k] * 1e-3
        assert abs(likelihood(best + step) - likelihood(best - step)) / 2e-3 < 5e-3


def test_quality_learns_junk(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for k in range(120):
        junk = k % 3 == 0
        rows.append((k, "\n".join(" ".join(rng.choice(WORDS) + ("***" if junk else "") for _ in range(12)) for _ in range(8))))
        if k < 90:
            labels.append((k, int(not junk)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in quality.quality_rules(docs, field).collect()}
    assert all(kept[k] == (k % 3 != 0) for k in range(90, 120))
    assert quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")) is None


def test_sharding_against_the_ring(spark, docs, corpus):
    got = sharding.shard_rows(sharding.shard_sizes(docs), "doc_id", shards=5, nodes=3).collect()
    counts = Counter(r.shard for r in got)
    assert len(got) == len(corpus) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    rows = sharding.shard_rows(sharding.shard_sizes(docs), "doc_id", shards=5, nodes=3).collect()
    assert bag((r.doc_id, r.text_crc32, r.shard) for r in rows) == bag((r.doc_id, r.text_crc32, r.shard) for r in got)


def test_sharding_of_any_columns(spark):
    """Clashing names, a map, a hot key of which 400 rows are equal, null keys."""
    clash = ["cell", "before", "inside", "first", "stop", "slot0", "at", "arc", "part", "rank", "c0", "__at", "__arc", "shard", "slot"]
    rows = [(7 if k % 3 == 0 else None if k % 50 == 1 else k, {"a": k % 2} if k % 5 else None, *[0 if k % 3 == 0 else k] * len(clash)) for k in range(1200)]
    docs = spark.createDataFrame(rows, "id long, m map<string,int>, " + ", ".join(f"{c} long" for c in clash)).repartition(3)
    got = sharding.shard_rows(docs, "id", shards=7, nodes=5)
    assert got.columns == ["id", "m", *clash[:-2], "shard", "slot"]
    found = got.collect()
    assert bag((r.id, tuple(sorted((r.m or {}).items())), r.cell) for r in found) == bag((r[0], tuple(sorted((r[1] or {}).items())), r[2]) for r in rows)
    for s in range(7):
        slots = sorted(r.slot for r in found if r.shard == s)
        assert slots == list(range(len(slots))) and 171 <= len(slots) <= 172
    assert bag(found) == bag(sharding.shard_rows(docs.repartition(5), "id", shards=7, nodes=5).collect())


def test_overflow_goes_on_clockwise():
    rng = random.Random(4)
    owners, counts = [rng.randrange(4) for _ in range(20)], [rng.randrange(9) for _ in range(20)]
    owners[:4] = range(4)
    room = sharding.capacities(sum(counts), 4)
    placed = {}
    for arc, a, b, shard, slot in sharding.slices(counts, owners, room):
        for k in range(a, b):
            placed[arc, k] = (shard, slot + k - a)
    left, want, used = list(room), {}, [0] * 4
    waiting, step = [(arc, k) for arc, n in enumerate(counts) for k in range(n)], 0
    while waiting:
        rest = []
        for arc, k in waiting:
            s = owners[(arc + step) % 20]
            if left[s]:
                left[s] -= 1
                want[arc, k] = (s, used[s])
                used[s] += 1
            else:
                rest.append((arc, k))
        waiting, step = rest, step + 1
    assert placed == want


def test_toxicity_separates(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for k in range(300):
        w = [rng.choice(WORDS) + rng.choice(WORDS) for _ in range(60)]
        if k % 4 == 0:
            for _ in range(6):
                w[rng.randrange(60)] = rng.choice(["grimblast", "snorkvile", "wretchling"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    texts, toxic = toxicity.sample(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    scored = {r.doc_id: r for r in toxicity.score_toxicity(docs, toxicity.fit(texts, toxic)).withColumn("held_out", toxicity.held_out("doc_id")).collect()}
    held = [k for k in range(300) if scored[k].held_out]
    assert len(held) > 30 and sum((scored[k].predicted == 1) == (k % 4 == 0) for k in held) >= 0.95 * len(held)
    assert 0 <= scored[900].score == scored[901].score <= 1
    assert {r.score for r in toxicity.score_toxicity(docs, None).collect()} == {0.0}


def test_toxicity_of_held_out_rows(spark):
    """Area under the curve over the labelled rows of the test table that nothing was learnt from."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    texts, toxic = toxicity.sample(docs, labels)
    assert len(texts) <= toxicity.SAMPLE
    held = docs.join(labels.dropna(subset=["toxic"]), "doc_id").where(toxicity.held_out("doc_id"))
    found = [(r.score, r.toxic) for r in toxicity.score_toxicity(held, toxicity.fit(texts, toxic)).select("score", "toxic").collect()]
    bad, good = [x for x, t in found if t], [x for x, t in found if not t]
    wins = sum((a > b) + (a == b) / 2 for a in bad for b in good)
    assert len(bad) > 100 and wins / (len(bad) * len(good)) >= 0.88


def test_toxicity_of_repeats_long_texts_and_clashing_names(spark):
    model = toxicity.fit([b"plain words of some text " * 4, b"vile words of some text " * 4] * 30, np.array([False, True] * 30))
    text = "vile words of some text " * 20_000
    rows = [(1, text, "x", "y"), (1, text, "x", "y"), (None, text, None, None), (2, None, None, None), (3, "one", "a", "b")]
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string, score string, predicted string"), model)
    assert got.dtypes[-2:] == [("score", "double"), ("predicted", "int")] and len(got.columns) == 4
    scores = {}
    for r in got.collect():
        scores.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 and 0 <= min(v) <= 1 for v in scores.values())


def alnum(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_decontaminate(spark, docs, corpus, block_bytes):
    items = [(1, " ".join(words(corpus[8][1])[30:60]).upper()), (2, "one"), (3, None), (4, "..."), (None, corpus[20][1][:150]), (2, "one"), (7, "nothing of this kind stands anywhere")]
    found = dc.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = found.select("doc_id", "n_words", dc.n_hit().alias("n_hit"), "items", "lang").collect()
    want = []
    for r in corpus:
        w, hit, names = alnum(r[1]), set(), set()
        for i, text in items:
            q = alnum(text)
            n = min(13, len(q))
            for p in {tuple(q[k : k + n]) for k in range(max(1, len(q) - 12))} if q else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == p:
                        hit |= set(range(k, k + n))
                        names.add(None if i is None else str(i))
        want.append((r[0], len(w), len(hit), frozenset(names), "en"))
    assert bag((r.doc_id, r.n_words, r.n_hit, frozenset(r["items"]), r.lang) for r in got) == bag(want)


def test_mixing_against_sorted_hashes(docs, corpus):
    got = mixing.mix(docs).collect()
    sizes = Counter()
    for r in corpus:
        sizes[r[3]] += len(words(r[1]))
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        open_ -= over
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
    for s in names:
        taken = sum(r.copies * r.size for r in got if r.source == s)
        groups = Counter()
        for r in corpus:
            if r[3] == s:
                groups[hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:15]] += len(words(r[1]))
        assert abs(taken - target[s]) <= max(groups.values()) / 2 + 1e-6


def test_mixed_documents_are_repeated(docs):
    want = {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id] = r.copies
    got = Counter(r.doc_id for r in mixing.mixed_documents(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect())
    assert got and set(got.values()) <= {1, 2, 3}


def test_licenses_of_ties_repeats_and_clashing_names(spark):
    """The earliest of equal units; repeated rows and null ids each give theirs; a whole license is found as itself."""
    whole = licenses.TEMPLATES["mit-text"]
    rows = [(1, "Released under the MIT License.\nReleased under the MIT License.", "x"), (1, "Released under the MIT License.\nReleased under the MIT License.", "x"), (None, "a b c Released under the MIT License.", None), (2, f"Copyright 2020 X\n\n{whole}\n\ndef main(): pass", "y")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    short = bag((r.doc_id, r.license, r.dice, r.first_word, r.n_words) for r in got if r.license == "mit")
    assert short == Counter({(1, "mit", 1.0, 0, 5): 2, (None, "mit", 1.0, 3, 5): 1})
    assert [(r.doc_id, r.dice, r.first_word) for r in got if r.license == "mit-text"] == [(2, 1.0, 3)]


def test_licenses(spark):
    text = "x y z\nReleased under the MIT license!\n\nLICENSED under CC BY-NC 4.0\nReleased under the MIT License."
    rows = [(1, text), (2, None), (3, ""), (4, "one"), (5, "Permission is hereby granted, free of charge, to any person\nobtaining a copy")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert bag((r.doc_id, r.license, round(r.dice, 6), r.first_word, r.n_words) for r in got) == bag([(1, "mit", 1.0, 3, 5), (1, "cc-by-nc-4.0", 1.0, 8, 7)])


def test_licenses_within_other_text(spark):
    """Notices inside lines and over several lines, against all windows that begin and end with a template's bigram."""
    rng = random.Random(12)
    notices, texts = sorted(licenses.TEMPLATES.items()), ["Copyright 2020 X. Released under the MIT License. See " + "some prose " * 9]
    for k in range(40):
        w = alnum(notices[k % len(notices)][1])
        for _ in range(k % 4):
            w[rng.randrange(len(w))] = rng.choice([*WORDS, "the", "license", "under"])
        w = [rng.choice(WORDS) for _ in range(20)] + w + [rng.choice(WORDS) for _ in range(20)] + w[: k % 5]
        texts.append("".join(x + ("\n" if rng.random() < 0.1 else " ") for x in w))
    want = []
    for i, text in enumerate(texts):
        w = alnum(text)
        pairs = list(zip(w, w[1:]))
        units = [(0, len(w))]
        for gap in ("\n", "\n\n"):
            at = 0
            for part in text.split(gap):
                units.append((at, len(alnum(part))))
                at += len(alnum(part))
        for name, notice in notices:
            own = set(zip(alnum(notice), alnum(notice)[1:]))
            ends = [k for k, p in enumerate(pairs) if p in own]
            best = None
            for a, n in units + [(a, b - a + 2) for a in ends for b in ends if a <= b and b - a + 1 <= len(own) * 1.5 + 1e-9]:
                u = set(pairs[a : a + n - 1]) if n > 1 else set()
                dice = 2 * len(u & own) / (len(u) + len(own))
                if dice >= 0.8:
                    best = min(best or (0,), (-dice, a, n))
            if best:
                want.append((i, name, round(-best[0], 6), *best[1:]))
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert bag((r.doc_id, r.license, round(r.dice, 6), r.first_word, r.n_words) for r in got) == bag(want)
    assert (0, "mit", 1.0, 3, 5) in want and len({w[0] for w in want}) > 20


def test_empty_tables(spark, nothing):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert substring_dedup.substring_dedup(nothing).count() == suffix_dedup.suffix_dedup(nothing).count() == 0
    assert minhash.near_duplicates(nothing).count() == line_dedup.line_dedup(nothing).count() == 0
    assert licenses.scan_licenses(nothing).count() == dc.decontaminate(nothing, empty).count() == 0
    assert mixing.mix(nothing).count() == sharding.shard_rows(nothing, "doc_id").count() == 0
    assert quality.quality_rules(nothing, None).count() == toxicity.score_toxicity(nothing, None).count() == 0


def test_no_benchmark(spark, docs, corpus):
    found = dc.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert found.count() == len(corpus) and found.where("size(hits) > 0 OR size(items) > 0").isEmpty()
