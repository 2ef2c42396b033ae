"""Columns of any name and type beside those that operators read, and results that follow from whole simulations."""

import random
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as cp
from waymend.llm import decontaminate as dc
from waymend.llm import fuzzy_prints, licenses, line_dedup, minhash, mixing, names, quality, sharding, substring_dedup, suffix_dedup, toxicity

DIR = "/root/testdata/sf0.001"
TEXT = " ".join(f"word{k}" for k in range(80))
#: Names that operators use inside or add, in another case too, and types that can't be compared or have blanks in their fields.
EXTRA = "__key string, __copy int, __copies int, __source string, __threshold long, KEPT string, SHARD int, Slot int, N_WORDS string, hits map<string,int>, `a b` struct<`c d`:int,`e.f`:array<int>>, `x.y` string, c0 string, c5 string, copies string, print string, part int, arc int, own int"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def filled(k):
    return (f"k{k}", 10 + k, 20 + k, f"s{k}", 30 + k, "KEPT", 40 + k, 50 + k, "NW", {"m": k}, (k, [k]), "xy", "c0", "c5", "cp", "pr", 60 + k, 70 + k, 80 + k)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "en", "a", 9), (1, TEXT, "en", "a", 9), (1, TEXT.upper()[:400], "en", None, 9), (2, f"{TEXT} more", None, "a", None), (None, TEXT, "en", "b", 9), (3, None, None, None, None), (4, "", "en", "b", 0)]
    return spark.createDataFrame([(*r, *filled(k)) for k, r in enumerate(rows)], DOCS)


def values(df, but=()):
    """Rows without the columns named, case aside, as text."""
    at = [k for k, c in enumerate(df.columns) if c.lower() not in but]
    return Counter(str([r[k] for k in at]) for r in df.collect())


@pytest.mark.parametrize("added,operator", [
    (("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_lines", "content_share", "base_failed", "kept"), lambda d: quality.quality_rules(d, None)),
    (("score", "predicted"), lambda d: toxicity.score_toxicity(d, None)),
    (("n_words", "hits", "items"), lambda d: dc.decontaminate(d, d.sparkSession.createDataFrame([(7, TEXT)], "item_id long, text string"))),
    (("n_words", "hits", "items"), lambda d: dc.decontaminate(d, d.sparkSession.createDataFrame([(7, TEXT), (8, "another item of some words, " * 9)], "item_id long, text string"), block_bytes=300)),
    (("shard", "slot"), lambda d: sharding.shard_rows(d, "doc_id", 3)),
    (("shard", "slot"), lambda d: sharding.shard_rows(d, "slot", 3)),
    (("shard", "slot"), lambda d: sharding.shard_rows(d, "hits", 3)),
])
def test_other_columns_are_left_alone(docs, added, operator):
    done = operator(docs)
    assert [c for c in done.columns if c.lower() not in added] == [c for c in docs.columns if c.lower() not in added]
    assert [c for c in done.columns if c.lower() in added] == [c for c in done.columns[-len(added) :]] and len({c.lower() for c in done.columns}) == len(done.columns)
    assert values(done, added) == values(docs, added)


def test_mix_keeps_columns_and_stops_at_its_most(spark, docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    # Equal to mix(), row by row: a row as often as it says.
    want = Counter()
    often = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(docs).collect()}
    for text, row in zip((str(list(r)) for r in docs.collect()), docs.collect()):
        want[text] += often[row.doc_id, row.source, len((row.text or "").split())]
    assert values(mixed) == +want
    # A small source, capped at three times its size, has rows without words: they come three times at most.
    rows = [(k, "", "small") for k in range(400)] + [(1000, "one two three", "small")] + [(2000 + k, "word " * 300, "large") for k in range(40)]
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert max(r.copies for r in mixing.mix(some).collect()) == 3
    assert max(r[1] for r in mixing.mixed_documents(some).groupBy("doc_id").count().collect()) == 3


def test_targets_over_many_sources(spark):
    """Against water filling: raise the level step by step, sources at their cap stay there."""
    rng = random.Random(6)
    sizes = {f"s{k:04d}": rng.choice([0, 1, 5, 40, 400, 9000]) for k in range(700)} | {None: 77}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left, weights = sum(sizes.values()) - sum(target.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > 3 * sizes[s] * weights}
        if not over:
            break
        target |= {s: 3 * sizes[s] for s in over}
        open_ -= over
    target |= {s: left * weight[s] / weights for s in open_}
    assert all(abs(got[s] - target[s]) < 1e-6 * max(1, target[s]) for s in order)


def test_stages_keep_all_columns(spark, docs):
    long = docs.where("doc_id IN (1, 2)")
    for (name, stage), loss in zip(cp.STAGES[:4], (2, 3, 3, 0)):
        kept = stage(spark, long, DIR)
        assert kept.columns == docs.columns
        assert set(values(kept)) <= set(values(docs)), name
    near = cp.near_dedup(spark, docs, DIR)
    assert set(values(near)) <= set(values(docs)) and near.where("doc_id = 1").count() == 2 and near.where("doc_id = 2").count() == 0
    assert [c for c in cp.sharding(spark, docs, DIR).columns if c.lower() not in ("shard", "slot")] == [c for c in docs.columns if c.lower() not in ("shard", "slot")]


@pytest.mark.parametrize("operator", [
    lambda d: substring_dedup.substring_dedup(d), lambda d: suffix_dedup.suffix_dedup(d), lambda d: minhash.near_duplicates(d), lambda d: line_dedup.line_dedup(d), lambda d: fuzzy_prints.fuzzy_prints(d),
])
def test_ids_may_be_structs(spark, operator):
    kind = T.StructType().add("a b", T.IntegerType()).add("c", T.StringType())
    rows = [((k // 2, "x"), f"{TEXT}\nline of its own {k}, long enough to be looked at as a line") for k in range(8)]
    done = operator(spark.createDataFrame(rows, T.StructType().add("doc_id", kind).add("text", "string")))
    assert sorted(tuple(r.doc_id) for r in done.select("doc_id").collect()) == sorted(i for i, _ in rows)


def spark_hash(*values):
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def simulated(rows, shards, nodes, many=(), at_least=1 << 60):
    """Every row's shard, asking one node after the other: rows of an arc by part, position and values."""
    where = sorted((zlib.crc32(f"shard {s} node {v}".encode()), s) for s in range(shards) for v in range(nodes))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    waiting = defaultdict(list)
    for row in rows:
        at = spark_hash(row[0]) % (1 << 32)
        arc = sum(p < at for p, _ in where) % len(where)
        waiting[arc].append((spark_hash(*row) % 64, at, tuple((v is not None, v or 0) for v in row), row))
    for arc in waiting:
        waiting[arc].sort()
    placed, step = [], 0
    while any(waiting.values()):
        for arc in sorted(waiting):
            shard = where[(arc + step) % len(where)][1]
            taken, waiting[arc] = waiting[arc][: room[shard]], waiting[arc][room[shard] :]
            room[shard] -= len(taken)
            placed += [(*r[-1], shard) for r in taken]
        step += 1
    return placed


def test_every_row_goes_where_the_ring_says(spark):
    rng = random.Random(21)
    texts = [(k, None if k % 19 == 0 else "é" * rng.randrange(40)) for k in range(900)] + [(5, "twice"), (5, "twice"), (None, "no id"), (None, None)]
    sized = sharding.shard_sizes(spark.createDataFrame(texts, "doc_id long, text string").repartition(5))
    plain = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts), key=str)
    assert sorted((tuple(r) for r in sized.collect()), key=str) == plain
    got = sharding.shard_rows(sized, "doc_id", 7, 4).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard) for r in got) == Counter(simulated(plain, 7, 4))
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_one_more_shard_moves_few_rows(spark):
    rows = spark.range(40_000).select(F.col("id").alias("doc_id"))
    before, after = (sharding.shard_rows(rows, "doc_id", n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (16, 17))
    both = before.join(after, "doc_id").agg(F.avg((F.col("s16") != F.col("s17")).cast("double")), F.avg(((F.col("s16") != F.col("s17")) & (F.col("s17") < 16)).cast("double"))).first()
    # A new shard's share is 1 / 17 = 0.059; what moves beside that evens loads out.
    assert 0.058 < both[0] < 0.13 and both[1] < 0.07


def test_many_equal_rows_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "MANY", 50)
    rows = spark.createDataFrame([(None, "same")] * 3000 + [(k, "own") for k in range(200)] + [(None, "other")] * 60, "doc_id long, text string").repartition(6)
    got = sharding.shard_rows(rows, "doc_id", 4).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(None, "same"): 3000, (None, "other"): 60, **{(k, "own"): 1 for k in range(200)}})
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(815)) for s in slots.values())


def test_inner_names(spark):
    df = spark.createDataFrame([(1, 2)], "Text int, shard int")
    inner = names.Inner(df, ("SHARD",))
    assert inner.at("text") == "c0" and inner.df.select(*inner.outer()).columns == ["Text"]
    with pytest.raises(ValueError):
        inner.at("other")
    assert names.ddl(T.StructType().add("a b", T.MapType(T.StringType(), T.ArrayType(T.LongType())))) == "struct<`a b`: map<string, array<bigint>>>"
