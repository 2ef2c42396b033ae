"""The order of rows in each epoch of training, without a sort: a keyed permutation of row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ranked

#: Steps of the permutation, and how often a number outside the rows is permuted again; numbers outside are fewer than the
#: side of the square that the rows fill, so this is enough: for 4,096 rows and less always, for more with a chance below 64**-64 a row.
STEPS, WALKS = 4, 64


def sides(n: int) -> tuple[int, int]:
    """A rectangle of a * b numbers that holds n, with less than a to spare."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _draw(seed: int, epoch: Column, step: int, half: Column, room: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), epoch.cast("string"), F.lit(str(step)), half.cast("string"))), 1, 8), 16, 10).cast("long") % room


def permuted(number: Column, epoch: Column, n: int, seed: int = 42) -> Column:
    """Where row `number`, from 0 to n - 1, comes in an epoch: each epoch is a permutation.

    The number's two digits, of bases a and b, are moved in turn by a hash of the other one; what falls outside 0 to n - 1 goes on from there.
    """
    a, b = sides(n)

    def step(v: Column) -> Column:
        high, low = F.floor(v / b).cast("long"), v % b
        for k in range(0, STEPS, 2):
            high = (high + _draw(seed, epoch, k, low, a)) % a
            low = (low + _draw(seed, epoch, k + 1, high, b)) % b
        return high * b + low

    return F.aggregate(F.array_repeat(F.lit(0), WALKS), step(number.cast("long")), lambda v, _: F.when(v < n, v).otherwise(step(v)))


def epoch_batches(rows: DataFrame, key: str, epochs: int, batch: int, seed: int = 42) -> DataFrame:
    """epoch, batch, place and the key of each row: every epoch holds each row once, its batches are numbered from 0 and full but for the last.

    Rows are numbered once by key, range by range; no epoch sorts them. Rows of equal keys are told apart by their number.
    """
    placed = ranked(rows.select(key), key, "number")
    n = placed.count()
    dealt = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    dealt = dealt.withColumn("at", permuted(F.col("number"), F.col("epoch"), max(n, 1), seed))
    return dealt.select("epoch", F.floor(F.col("at") / batch).alias("batch"), (F.col("at") % batch).alias("place"), key)
