"""Running numbers along long sequences, without bringing a sequence to one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

#: A key that holds more than this part of all rows meets them by broadcast; there are no more such keys than SHARES.
SHARES = 5_000

#: How what a kind of running value has summed up before is put together with what comes after.
JOINED: dict[str, Callable[[Column, Column], Column]] = {
    "sum": lambda a, b: a + b,
    "bit_xor": lambda a, b: a.bitwiseXOR(b),
    "max": lambda a, b: F.greatest(a, b),
}


def along(rows: DataFrame, keys: list[str], order: list[Column], running: dict[str, tuple[str, str]]) -> DataFrame:
    """rows with running values of each key's rows in the given order, the row itself included; the result is a written table.

    running: name to (kind, column), kinds as in JOINED; columns without nulls. Rows are
    range-partitioned by key and order, so that a long sequence lies in
    several partitions; each runs for itself, and what stands in front of it
    is added. Only sequences that cross a border have such a part: no more rows than partitions.
    """
    tick = Window.partitionBy("along_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("along_part", F.spark_partition_id()))
    fold = {name: getattr(F, kind)(col) for name, (kind, col) in running.items()}
    sums = dealt.groupBy("along_part", *keys).agg(*(x.alias(f"own_{name}") for name, x in fold.items()))
    crossing = sums.groupBy(*keys).agg(F.min("along_part").alias("first_part"), F.max("along_part").alias("last_part")).where("first_part < last_part")
    before = Window.partitionBy(*keys).orderBy("along_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.join(F.broadcast(crossing), keys, "left_semi")
    carried = carried.select("along_part", *keys, *(getattr(F, kind)(f"own_{name}").over(before).alias(f"own_{name}") for name, (kind, _) in running.items()))
    found = dealt.select("*", *(x.over(tick).alias(f"here_{name}") for name, x in fold.items())).join(F.broadcast(carried), ["along_part", *keys], "left")
    whole = {name: F.when(F.col(f"own_{name}").isNull(), F.col(f"here_{name}")).otherwise(JOINED[kind](F.col(f"own_{name}"), F.col(f"here_{name}"))) for name, (kind, _) in running.items()}
    return cut(found.select(*rows.columns, *(x.alias(name) for name, x in whole.items())))


def met(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of rows with keyed, which has one row for each key and in `count` how many of the rows hold it; `total` is their sum.

    A hot key's rows stay where they are: keys above total / SHARES are sent to
    them, less than SHARES keys by their counts. The others are shuffled as usual.
    """
    often = F.col(count) * SHARES > total
    hot, cold = F.broadcast(keyed.where(often)), keyed.where(~often)
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))
