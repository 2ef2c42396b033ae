"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket. A source's running sums over its
buckets show in which one its budget ends; only that bucket is refined, by the
next bits of the hash, until one hash value is left. A document is taken as
often as its source's target holds the whole source, and once more if its hash
lies below the threshold. Nothing is sorted, nothing sampled, reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .along import along
from .names import Inner
from .session import cut, table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
HASH_BITS = 60
LEVEL_BITS = 12
BROADCAST_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix_hash(id_: Column) -> Column:
    """60 bits of the id's MD5; a null id hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target of a table (source, source_size): weights by order of source, null last.

    A target stops at `most` times the source's size; what is above is shared
    by weight among the others. The level where shares meet the caps follows
    from running sums over the sources in order of cap / weight, by parts of
    the sources; the sums of all and the level reach the driver.
    """
    named = sizes.select(F.lit(0).alias("all"), F.col("source"), F.col("source_size").cast("long").alias("source_size"), F.lit(1).cast("long").alias("one"))
    named = along(named, ["all"], [F.col("source").asc_nulls_last()], {"place": ("sum", "one")})
    weight = F.element_at(F.array(*(F.lit(w).cast("long") for w in weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    shares = named.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    shares = along(shares.select("all", "source", "source_size", "weight", "cap", "full_at"), ["all"], [F.col("full_at"), F.col("source").asc_nulls_last()], {"caps": ("sum", "cap"), "weights": ("sum", "weight")})
    size, weights_sum = shares.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(size) - (F.col("caps") - F.col("cap"))).cast("double") / (F.lit(weights_sum) - (F.col("weights") - F.col("weight"))).cast("double")
    fits = shares.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap"))
    # From the first source that stays below its cap on, levels fall, so the first one is the largest.
    level = fits.agg(F.max("level")).first()[0]
    cap = F.col("cap").cast("double")
    return shares.select("source", "source_size", (cap if level is None else F.least(cap, F.lit(level) * F.col("weight"))).alias("target"))


def thresholds(rows: DataFrame, sources: DataFrame, bits: int = LEVEL_BITS) -> DataFrame:
    """source, copies, threshold: every document is taken `copies` times, those of lower hash once more.

    rows: source, size, hash. The running sum comes as near to the budget as
    whole hash values allow; where two are as near, the lower one holds.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = sources.withColumn("copies", whole).select("source", "copies", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for left in range(HASH_BITS - bits, -1, -bits):
        inside = rows.alias("r").join(state.alias("s"), F.expr("r.source <=> s.source AND shiftright(r.hash, {}) = s.prefix".format(left + bits)) if left + bits < HASH_BITS else F.expr("r.source <=> s.source"))
        sums = inside.groupBy(F.col("s.source").alias("source"), F.col("copies"), F.col("budget"), F.col("below"), F.shiftright("hash", left).alias("prefix")).agg(F.sum("size").alias("n"))
        along = Window.partitionBy("source").orderBy("prefix")
        running = sums.withColumn("upto", F.col("below") + F.sum("n").over(along))
        # The bucket where the budget ends: the first whose running sum is above it.
        ends = running.where("upto > budget").groupBy("source", "copies", "budget").agg(F.min(F.struct("prefix", (F.col("upto") - F.col("n")).alias("below"), "upto")).alias("b"))
        state = ends.select("source", "copies", "budget", F.col("b.prefix").alias("prefix"), F.col("b.below").alias("below"), F.col("b.upto").alias("upto"))
    nearer = F.col("upto") - F.col("budget") < F.col("budget") - F.col("below")
    return state.select("source", "copies", F.when(nearer, F.col("prefix") + 1).otherwise(F.col("prefix")).alias("threshold"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size (words), source_size, target, copies (0 to `most`).

    Null and empty texts have size 0; a source of size 0 has target 0 and
    copies 0. Null sources are one source, the last. Rows of one doc_id share
    a hash, so they are taken alike. An empty table gives an empty table.
    Other columns are not read.
    """
    text = F.col(f"`{text_col}`")
    rows = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), mix_hash(F.col(f"`{id_col}`")).alias("hash")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    limits = cut(thresholds(rows.select("source", "size", "hash"), sources))
    joined = rows.alias("r").join(sources.alias("s"), F.expr("r.source <=> s.source")).join(limits.alias("l"), F.expr("r.source <=> l.source"), "left")
    copies = F.coalesce(F.col("l.copies") + (F.col("r.hash") < F.col("l.threshold")).cast("long"), F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # Where a source is taken `most` times already, texts without words may lie below its threshold: no more of them either.
    copies = F.least(copies, F.lit(most).cast("long"))
    return joined.select("r.doc_id", F.col("r.source").alias("source"), "r.size", "source_size", "target", copies.alias("copies"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The mix itself: each row of docs as often as mix() takes it (`most` times at the most), in no order; rows that it doesn't take go.

    Columns keep their names and values, whatever they are called.
    """
    inner = Inner(docs)
    rows = cut(inner.df.select(inner.col(source_col).alias("source"), n_words(inner.col(text_col)).alias("size"), mix_hash(inner.col(id_col)).alias("hash")))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    limits = sources.select("source", whole.alias("whole")).alias("s").join(thresholds(rows, sources).alias("l"), F.expr("s.source <=> l.source"), "left")
    limits = cut(limits.select(F.col("s.source").alias("of"), F.col("whole"), F.coalesce("threshold", F.lit(0)).alias("threshold")))
    # A row for each source; sent to all executors only while there are few.
    limits = F.broadcast(limits) if limits.count() <= BROADCAST_SOURCES else limits
    taken = inner.df.join(limits, inner.col(source_col).eqNullSafe(F.col("of")))
    copies = F.least(F.col("whole") + (mix_hash(inner.col(id_col)) < F.col("threshold")).cast("long"), F.lit(most).cast("long"))
    repeated = taken.withColumn("copies", copies).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return repeated.select(*inner.outer())


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = """
WITH r AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s
), l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM w
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT max(level) FROM l WHERE level * weight <= cap) * weight, CAST(cap AS DOUBLE))) AS target FROM l
), c AS (
  SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies,
    sum(size) OVER (PARTITION BY r.source ORDER BY h) AS upto, sum(size) OVER (PARTITION BY r.source, h) AS own
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, target - copies * source_size AS budget FROM c
)
SELECT doc_id, size, source_size, target,
  CAST(size * (copies + CASE WHEN upto <= budget THEN 1 WHEN upto - own <= budget AND upto - budget < budget - (upto - own) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
