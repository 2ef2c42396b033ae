"""MinHash near-dedup: many universal hash minima with banding, signature
verification, confirmation on full sets, and connected components by
alternating large-star and small-star.

Links between different sets are found in two rounds. In the first, every
member of a band's bucket is compared with the bucket's hub only, the member
that most others share buckets with, so a bucket of n documents costs n
comparisons; signatures rule most pairs out, the full sets decide. A candidate
group is what buckets join. Where one still has several components, the second
round looks for links between them. Shingle prints are counted within the
group, in a table of bounded size: only those that stand in several of its
components can be shared by a link, so a member of which too few do is out. Of
the others' prints only the rarest, as many as no link can all miss, are dealt
out and met; a member whose rarest meet no other component's is out too. What is left
is compared exactly, by its shared prints, through inverted indexes over blocks
of bounded size, each for sets of like size, which bounded shares of the members
outside the largest component pass. What one component holds already needs no
further link, and one link between two components is enough, so neither round
gives a row for each pair of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import LOWER, Prints, Words, chunks, lists, mixed, ranges, row_of
from .names import ddl
from .session import cut, table

HASHES = 112
BAND_ROWS = 4
#: Ids that are sent to all executors to meet their texts there; more are shuffled with them.
BROADCAST_IDS = 100_000
#: Shingles of one block of a candidate group's inverted index, and members that seek links in one task.
BLOCK_SHINGLES = 300_000
TASK_SEEKERS = 1000
#: Counters of the second round's shingles; their non-zero ones pass through the driver, 8 bytes each, and 8 MB go to each executor.
SLOTS = 1 << 21
#: A shingle that holds more than this part of the second round's rows is met by broadcast; there are no more than HOT_PART of them.
HOT_PART = 5000
SHINGLE_WORDS = 5
PERCENT = 80
#: Least share of equal minima at which a pair goes on to the full sets: six standard
#: deviations below the threshold at 112 hashes.
LEAST_SHARE = 0.57


def shingle_sets(values: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each row, ordered within rows, and their bounds."""
    words = Words(LOWER[values], offsets)
    n = np.diff(words.bounds)
    units = words.prints()
    prints = Prints(units)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    start = ranges(words.bounds[:-1], count)
    row = np.repeat(np.arange(len(n)), count)
    found = prints.of(start, np.minimum(start + size, words.bounds[row + 1]))
    order = np.lexsort((found, row))
    found, row = found[order], row[order]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
    found, row = found[fresh], row[fresh]
    return found, np.searchsorted(row, np.arange(len(n) + 1))


def _factors(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, hashes, dtype=np.uint64)


def _signatures(size: int, hashes: int, band: int):
    """Documents to set size, two fingerprints of the set, bands and a byte of each minimum."""
    factors, shifts = _factors(hashes)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in chunks(batch["text"], 1 << 19):
                sets, bounds = shingle_sets(values, offsets, size)
                n = len(offsets) - 1
                full = np.flatnonzero(np.diff(bounds) > 0)
                minima = np.zeros((n, hashes), np.uint32)
                if len(full):
                    heads = bounds[:-1][full]
                    for k in range(hashes):
                        # (a * x + b) mod 2**64, its upper half: a universal family.
                        minima[full, k] = np.minimum.reduceat(((sets * factors[k] + shifts[k]) >> np.uint64(32)).astype(np.uint32), heads)
                bands = np.zeros((n, hashes // band), np.uint64)
                for k in range(band):
                    bands = mixed(bands ^ minima[:, k::band].astype(np.uint64) ^ np.arange(1, hashes // band + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                prints = []
                for salt in (0x51, 0xA3):
                    sums = np.zeros(len(sets) + 1, np.uint64)
                    np.cumsum(mixed(sets ^ np.uint64(salt)), out=sums[1:])
                    prints.append(mixed(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64))
                bytes_ = mixed(minima.astype(np.uint64)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].slice(row, n), pa.array(np.diff(bounds)), pa.array(prints[0]), pa.array(prints[1]),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (hashes // band)), pa.array(bands.ravel().view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * hashes), pa.py_buffer(bytes_.ravel())]),
                    ],
                    names=["doc_id", "n_shingles", "left_print", "right_print", "bands", "signature"],
                )

    return sign


def _prints(size: int):
    """Rows with a text to rows with its distinct shingles, told apart by group, and a fingerprint of the set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, values, offsets in chunks(batch["text"], 1 << 19):
                sets, bounds = shingle_sets(values, offsets, size)
                part = batch.slice(row, len(offsets) - 1)
                keys = mixed(sets ^ np.asarray(part["salt"]).view(np.uint64)[row_of(bounds)])
                sums = np.zeros(len(keys) + 1, np.uint64)
                np.cumsum(mixed(keys), out=sums[1:])
                unit = pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part["id"], part["place"], part["label"], part["seeks"], pa.array(np.diff(bounds)), unit, lists(bounds, pa.array(keys.view(np.int64)))],
                    names=["id", "place", "label", "seeks", "n", "unit", "keys"],
                )

    return read


def _across(percent: int):
    """Links between components, from rows sorted by cell (a block, a share of its seekers) and role: members first, then those that seek.

    A block's members become an inverted index; seekers stream past it. Each
    seeker gives one link for each other component that it is linked with.
    """

    def seek(index: tuple, ids: list, component: np.ndarray, keys: np.ndarray, bounds: np.ndarray, own: np.ndarray) -> Iterator[tuple]:
        tokens, heads, postings, members, sizes, labels = index
        if not len(tokens):
            return
        at = np.searchsorted(tokens, keys)
        hit = np.flatnonzero(tokens[np.minimum(at, len(tokens) - 1)] == keys)
        row = row_of(bounds)[hit]
        at = at[hit]
        edges = np.searchsorted(row, np.arange(len(bounds)))
        for k in range(len(bounds) - 1):
            t = at[edges[k] : edges[k + 1]]
            shared = np.bincount(postings[ranges(heads[t], heads[t + 1] - heads[t])], minlength=len(sizes))
            linked = np.flatnonzero((100 * shared >= percent * (own[k] + sizes - shared)) & (labels != component[k]))
            for j in linked[np.unique(labels[linked], return_index=True)[1]].tolist():
                yield ids[k], members[j]

    def indexed(held: list[tuple]) -> tuple:
        ids, labels, keys, counts, sizes = zip(*held) if held else ((), (np.zeros(0, np.int64),), (np.zeros(0, np.int64),), (np.zeros(0, np.int64),), (np.zeros(0, np.int64),))
        every, counts = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(every, kind="stable")
        tokens, heads = np.unique(every[order], return_index=True)
        return tokens, np.append(heads, len(every)), np.repeat(np.arange(len(counts)), counts)[order], [i for part in ids for i in part], np.concatenate(sizes), np.concatenate(labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for batch in batches:
            n, found = batch.num_rows, ([], [])
            cell, seeks = batch["cell"].to_pylist(), batch["seeks"].to_numpy(zero_copy_only=False)
            component, sizes = batch["label"].to_numpy(zero_copy_only=False), np.asarray(batch["n"])
            bounds = np.asarray(batch["keys"].offsets)
            keys, bounds = np.asarray(batch["keys"].values)[bounds[0] : bounds[-1]], bounds - bounds[0]
            change = np.flatnonzero([True] + [cell[k] != cell[k - 1] or seeks[k] != seeks[k - 1] for k in range(1, n)]) if n else np.zeros(0, np.int64)
            for a, b in zip(change, np.append(change[1:], n)):
                if cell[a] != key:
                    key, held, index = cell[a], [], None
                ids, own, edge = batch["id"].slice(a, b - a).to_pylist(), keys[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]
                if not seeks[a]:
                    held.append((ids, component[a:b], own.copy(), np.diff(edge), sizes[a:b]))
                    continue
                if index is None:
                    index, held = indexed(held), []
                for x, y in seek(index, ids, component[a:b], own, edge, sizes[a:b]):
                    found[0].append(x)
                    found[1].append(y)
            if found[0]:
                kind = batch.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(found[0], kind), pa.array(found[1], kind)], names=["a", "b"])

    return run


def _confirm(size: int, percent: int):
    """Keeps the pairs whose full sets have 100 * intersection >= percent * union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                both = []
                for side in ("text_a", "text_b"):
                    sets, rows, base = [], [], 0
                    for row, values, offsets in chunks(part[side], 1 << 21):
                        found, bounds = shingle_sets(values, offsets, size)
                        sets.append(found)
                        rows.append(row_of(bounds) + row)
                    both.append((np.concatenate(sets), np.concatenate(rows)))
                (a, row_a), (b, row_b) = both
                value, row = np.concatenate([a, b]), np.concatenate([row_a, row_b])
                order = np.lexsort((value, row))
                value, row = value[order], row[order]
                twice = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
                n = part.num_rows
                shared = np.bincount(row[1:][twice], minlength=n)
                union = np.bincount(row, minlength=n) - shared
                good = pa.array((100 * shared >= percent * union) & (union > 0))
                yield pa.RecordBatch.from_arrays([part["a"].filter(good), part["b"].filter(good)], names=["a", "b"])

    return confirm


def _alike(share: float, hashes: int, percent: int):
    """Keeps pairs whose set sizes allow the similarity and whose signatures agree often enough."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = np.asarray(batch["n_a"]), np.asarray(batch["n_b"])
            good = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
            for at in range(0, batch.num_rows, 1 << 14):
                part = batch.slice(at, 1 << 14)
                a, b = (np.frombuffer(part[c].buffers()[2], np.uint8)[part[c].offset * hashes :][: part.num_rows * hashes].reshape(-1, hashes) for c in ("signature_a", "signature_b"))
                good[at : at + part.num_rows] &= (a == b).mean(axis=1) >= share
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(keep), batch["b"].filter(keep)], names=["a", "b"])

    return alike


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its least node) of the nodes of links (a, b), by alternating large-star and small-star.

    Large-star links every larger neighbour of a node to the least of its
    neighbourhood, small-star every smaller one; both keep the components, and
    the links become stars around each component's least node. Groups are only
    summed up (least neighbour), never gathered.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        small = cut(small)
        # Done when every node has one smaller neighbour at most, and none if it is one: stars around least nodes.
        ends = small.select("a", F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(small.select(F.col("b").alias("a"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        edges = small
        if ends.groupBy("a").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    # Every node has one smaller neighbour now: the least node of its component.
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _sketch(sets: DataFrame) -> np.ndarray:
    """How many rows of sets (label, keys) have keys of each slot, the lowest bits of a key; 0 where all of a slot's rows have one label."""
    slots = sets.select(F.xxhash64("label").alias("label"), F.explode("keys").alias("key")).groupBy(F.col("key").bitwiseAND(SLOTS - 1).cast("int").alias("slot"))
    slots = slots.agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("df")).where("least <> most")
    found = slots.select("slot", F.least("df", F.lit((1 << 31) - 1)).cast("int").alias("df")).toArrow()
    counts = np.zeros(SLOTS, np.int32)
    counts[found["slot"].to_numpy()] = found["df"].to_numpy()
    return counts


def _rarest(sketch: Broadcast, percent: int):
    """Rows whose set can be part of a link, with the prints that others can share, and of these the rarest ones, as many as no link can miss.

    Prints are ordered by their slots' counts and then by themselves. Any order that all sets share would do: of
    what two linked sets share, the first print has all the rest behind it in both of them. A slot holds
    several prints, so its counts are too high at the most, which keeps a set rather than loses it.
    """

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            bounds = np.asarray(batch["keys"].offsets)
            keys, row = np.asarray(batch["keys"].values)[bounds[0] : bounds[-1]], row_of(bounds - bounds[0])
            df = counts[keys & (SLOTS - 1)]
            least = np.maximum(-(-np.asarray(batch["n"]) * percent // 100), 1)
            met = np.bincount(row[df > 0], minlength=batch.num_rows)
            able = met >= least
            held = np.flatnonzero((df > 0) & able[row])
            held = held[np.lexsort((keys[held], df[held], row[held]))]
            ends = np.concatenate([[0], np.cumsum(met[able])])
            first = ranges(ends[:-1], met[able] - least[able] + 1)
            kept = batch.filter(pa.array(able))
            yield pa.RecordBatch.from_arrays(
                [*(kept[c] for c in ("id", "unit", "place", "label", "seeks", "n")), lists(ends, pa.array(keys[held])), lists(np.concatenate([[0], np.cumsum(met[able] - least[able] + 1)]), pa.array(keys[held][first]))],
                names=["id", "unit", "place", "label", "seeks", "n", "keys", "rare"],
            )

    return choose


def _meeting(tokens: DataFrame) -> DataFrame:
    """The rows of tokens (id, unit, label, key) whose key stands under several labels, with the number of its rows, df.

    Keys above a HOT_PART-th of the rows, HOT_PART at the most, are met by
    broadcast, so that no task gets all rows of a frequent key.
    """
    met = tokens.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("df"))
    met = cut(met.where("least <> most").select("key", "df"))
    hot = F.broadcast(met.where(F.col("df") * HOT_PART > tokens.count()))
    return tokens.join(hot, "key").unionByName(tokens.join(hot.select("key"), "key", "left_anti").join(met, "key"))


def _between(heads: DataFrame, place: DataFrame, nodes: DataFrame, source: DataFrame, kind: str, shingle: int, percent: int) -> DataFrame:
    """The second round: links (a, b) between components (nodes: node, component) of one candidate group (place: id, place)."""

    # Sets of one link differ in size by 100 / percent at most, so a member's links are in its own step of sizes or the next ones.
    def step(n: str) -> Column:
        return F.floor(F.log(n) / (math.log(100 / percent) * (1 + 1e-9))).cast("long") if percent < 100 else F.col(n).cast("long")

    around = F.explode(F.sequence(F.col("step") - 1, F.col("step") + 1))
    labels = place.join(nodes.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "place", F.coalesce("component", "id").alias("label"))
    labelled = cut(labels.join(heads.select("id", step("n_shingles").alias("step")).distinct(), "id"))
    parts = labelled.groupBy("place", "label").agg(F.count("*").alias("n"))
    groups = parts.groupBy("place").agg(F.count("*").alias("parts"), F.max_by("label", F.struct("n", "label")).alias("largest")).where("parts > 1")
    waiting = cut(labelled.join(groups, "place").select("id", "place", "label", "step", (F.col("label") != F.col("largest")).alias("seeks")))
    sought = waiting.where("seeks").select("place", around.alias("step")).distinct()
    near = cut(waiting.join(sought, ["place", "step"], "left_semi").select("id", "place", "label", "seeks").distinct())
    # At most BROADCAST_IDS narrow rows go to all executors.
    near = F.broadcast(near) if near.count() <= BROADCAST_IDS else near
    texts = source.join(near, "id").select("id", "place", "label", "seeks", F.xxhash64("place").alias("salt"), "text")
    sets = cut(texts.mapInArrow(_prints(shingle), f"id {kind}, place {kind}, label {kind}, seeks boolean, n long, unit long, keys array<long>"))
    # A link shares at least percent of each of its sets, and all that it shares stands under two labels.
    sent = source.sparkSession.sparkContext.broadcast(_sketch(sets))
    able = cut(sets.mapInArrow(_rarest(sent, percent), f"id {kind}, unit long, place {kind}, label {kind}, seeks boolean, n long, keys array<long>, rare array<long>"))
    sent.destroy()
    unit = ["id", "unit"]
    ready = able.join(_meeting(able.select(*unit, "label", F.explode("rare").alias("key"))).select(*unit).distinct(), unit, "left_semi")
    ready = cut(ready.drop("rare").withColumn("step", step("n")))
    blocks = cut(ready.groupBy("place", "step").agg(F.ceil(F.sum(F.size("keys")) / BLOCK_SHINGLES).cast("int").alias("blocks")))
    salts = cut(ready.where("seeks").groupBy("place").agg(F.ceil(F.count("*") / TASK_SEEKERS).cast("int").alias("salts")))

    def cells(rows: DataFrame, block: Column, salt: Column, seeks: bool) -> DataFrame:
        rows = rows.join(blocks, ["place", "step"]).withColumn("block", block).withColumn("salt", salt)
        return rows.select("id", "label", "n", "keys", F.concat_ws("/", F.col("place").cast("string"), "step", "block", "salt").alias("cell"), F.lit(seeks).alias("seeks"))

    # Members stand in one block of their step for each share of the seekers; a seeker passes all blocks of its steps.
    shared_out = ready.join(salts, "place")
    members = cells(shared_out, F.pmod(F.xxhash64("id"), F.col("blocks")), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)), False)
    seekers = cells(shared_out.where("seeks").withColumn("step", around), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), F.pmod(F.xxhash64("id", F.lit("salt")), F.col("salts")), True)
    dealt = members.unionByName(seekers).repartition("cell").sortWithinPartitions("cell", "seeks")
    return cut(dealt.mapInArrow(_across(percent), f"a {kind}, b {kind}"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS, percent: int = PERCENT, hashes: int = HASHES, band: int = BAND_ROWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """Groups of documents linked by shingle sets with 100 * intersection >= percent * union.

    Returns per row: doc_id, n_shingles, component_id (the smallest doc_id that
    links reach, its own included).

    Words are split at ASCII white space after A-Z are lower-cased; a text of
    fewer words than a shingle is one shingle; null and wordless texts have
    none and are linked with nothing. Rows that share a doc_id are one node of
    the graph: their links count for it, and their n_shingles are their own. A
    null doc_id gets component null and no links. Tables may be empty; other
    columns are not read. Ids must be orderable.
    """
    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"))
    kind = ddl(texts.schema["doc_id"].dataType)
    signed = cut(texts.mapInArrow(_signatures(shingle, hashes, band), f"doc_id {kind}, n_shingles long, left_print long, right_print long, bands array<long>, signature binary"))
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Equal sets are one class, with its smallest document as the one that is compared.
    classes = cut(full.groupBy("left_print", "right_print").agg(F.min("doc_id").alias("head")))
    equal = full.select("doc_id", "left_print", "right_print").join(classes, ["left_print", "right_print"]).select(F.col("doc_id").alias("a"), F.col("head").alias("b")).where("a <> b")
    # Only where a doc_id stands twice must rows be made distinct before they are joined.
    repeated = not full.groupBy("doc_id").count().where("count > 1").isEmpty()
    heads = full.join(classes.select(F.col("head").alias("doc_id"), "left_print", "right_print"), ["doc_id", "left_print", "right_print"], "left_semi")
    heads = heads.dropDuplicates(["doc_id", "left_print", "right_print"]) if repeated else heads
    heads = cut(heads.select(F.col("doc_id").alias("id"), "n_shingles", "bands", "signature"))
    members = heads.select("id", F.explode("bands").alias("band"))
    # Counts and hubs are written apart, so that members of a hot bucket can be split where they are joined.
    sizes = cut(members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(members.join(sizes, "band").select("id", "band", "n"))
    score = shared.groupBy("id").agg(F.sum("n").alias("score"))
    hubs = cut(shared.join(score, "id").groupBy("band").agg(F.max_by("id", F.struct("score", "id")).alias("hub")))
    pairs = cut(shared.join(hubs, "band").where("id <> hub").select(F.greatest("id", "hub").alias("a"), F.least("id", "hub").alias("b")).distinct())
    signs = heads.select("id", "n_shingles", "signature")
    source = texts.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    source = source.distinct() if repeated else source

    def verified(pairs: DataFrame) -> DataFrame:
        side = {x: signs.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("signature").alias(f"signature_{x}")) for x in "ab"}
        kept = cut(pairs.join(side["a"], "a").join(side["b"], "b").mapInArrow(_alike(least_share, hashes, percent), f"a {kind}, b {kind}").distinct())
        sides = kept.join(source.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(source.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return cut(sides.select("a", "b", "text_a", "text_b").mapInArrow(_confirm(shingle, percent), f"a {kind}, b {kind}").distinct())

    first = verified(pairs)
    nodes = connected_components(first)
    place = connected_components(pairs).select(F.col("node").alias("id"), F.col("component").alias("place"))
    found = connected_components(first.unionByName(_between(heads, place, nodes, source, kind, shingle, percent)).unionByName(equal))
    return signed.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen
), c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
