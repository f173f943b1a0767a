"""Row numbers, keyed permutations and lags of one long frame, without a window
over all of it.

Rows are sorted by ranges; a row's number is its place in its range after the
rows of the ranges before, whose counts are one number for each range. Lags look
at chunks of consecutive numbers, each with a halo: the last rows of the chunk
before it. A permutation is a keyed bijection of row numbers, so every row can
tell where it goes without asking another."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.panel import ensure, settled

#: Rows of a chunk, the least task of a lag.
CHUNK = 20_000
#: Rounds of the bijection.
ROUNDS = 6
_PRIME = 2_147_483_647


def numbered(df: DataFrame, order: list[str] | None = None, name: str = "__i") -> tuple[DataFrame, int]:
    """``df`` with row numbers from 0, in the order of some columns or as it comes,
    from a checkpoint; and how many rows there are. Rows that the order does not
    tell apart keep the places they got."""
    # A given number of ranges, so that later work on each row is not left to one task.
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order) if order else df
    rows = settled(rows.withColumn("__m", F.monotonically_increasing_id()))
    part = F.shiftright("__m", 33)
    # One row for each range.
    sizes = sorted((r["p"], r["n"]) for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before = np.append(0, np.cumsum([n for _, n in sizes])).tolist()
    offsets = df.sparkSession.createDataFrame([(p, int(b)) for (p, _), b in zip(sizes, before)], "__p long, __before long")
    out = rows.join(F.broadcast(offsets), part == F.col("__p"))
    place = F.col("__before") + F.col("__m") - F.shiftleft(F.col("__p"), 33)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(name)), int(before[-1])


def lagged(df: DataFrame, columns: list[str], p: int, order: list[str], chunk: int | None = None) -> DataFrame:
    """The columns of ``df``, and ``__{column}_{k}`` for k up to ``p``: the value k
    rows before in the given order, null at the beginning."""
    ensure(p > 0, "p must be positive")
    size = max(chunk or CHUNK, p + 1)
    rows, _ = numbered(df, order)
    home = F.floor(F.col("__i") / size)
    both = F.when(F.col("__i") % size >= size - p, F.array(home, home + 1)).otherwise(F.array(home))
    rows = rows.withColumn("__chunk", F.explode(both))
    w = Window.partitionBy("__chunk").orderBy("__i")
    lags = [F.lag(F.col(f"`{c}`"), k).over(w).alias(f"__{c}_{k}") for k in range(1, p + 1) for c in columns]
    rows = rows.select("*", *lags).filter(F.col("__chunk") == home)
    return rows.drop("__chunk", "__i")


# -- permutations ----------------------------------------------------------


def permutation_keys(seed: int, slot: int = 0) -> list[int]:
    """One key for each round of the bijection."""
    return [(seed * 1_000_003 + slot * 7_919 + k * 104_729 + 12_345) % _PRIME for k in range(ROUNDS)]


def _sides(n: int) -> tuple[int, int]:
    """a x b cells hold n numbers, with less than a of them to spare."""
    a = math.isqrt(max(n - 1, 0)) + 1
    return a, -(-n // a)


def _scrambled(v, key):
    """A number below 2^31 and a key as a number below 2^56 that looks random."""
    t = v * 1_664_525 + key
    if isinstance(v, Column):
        t = t.bitwiseXOR(F.shiftright(t, 13)) % _PRIME * 22_695_477 + key
        return t.bitwiseXOR(F.shiftright(t, 17))
    t = (t ^ (t >> 13)) % _PRIME * 22_695_477 + key
    return t ^ (t >> 17)


def _moved(x, n: int, keys: list[int] | Column):
    """One application of the bijection of a x b: in turns one half is shifted by a
    scramble of the other."""
    a, b = _sides(n)
    if not isinstance(x, Column):
        left, right = x // b, x % b
        for k, key in enumerate(keys):
            if k % 2:
                right = (right + _scrambled(left, key)) % b
            else:
                left = (left + _scrambled(right, key)) % a
        return left * b + right
    held = keys if isinstance(keys, Column) else F.array(*[F.lit(key).cast("long") for key in keys])
    rounds = F.transform(held, lambda key, k: F.struct((k % 2 == 1).alias("odd"), key.alias("key")))
    begin = F.struct(F.floor(x / b).alias("left"), (x % b).alias("right"))

    def one(s: Column, r: Column) -> Column:
        right = (s["right"] + _scrambled(s["left"], r["key"])) % b
        left = (s["left"] + _scrambled(s["right"], r["key"])) % a
        return F.when(r["odd"], F.struct(s["left"].alias("left"), right.alias("right"))).otherwise(F.struct(left.alias("left"), s["right"].alias("right")))

    return F.aggregate(rounds, begin, one, lambda s: s["left"] * b + s["right"])


def permuted(i, n: int, keys: list[int] | Column):
    """Where a keyed permutation of 0..n-1 sends the numbers ``i`` (a long column, or
    an array); for a column the keys may be an array column. Numbers that leave the range walk on until they are back, which
    takes less than a steps, and more than a few for no more than 1 / a each."""
    ensure(n < 1 << 60, "too many rows")
    if not isinstance(i, Column):
        x = _moved(np.asarray(i, np.int64), n, keys)
        while (x >= n).any():
            x = np.where(x >= n, _moved(x, n, keys), x)
        return x
    # All steps that can be needed, or so many that a number is still outside once in 10^30.
    a = _sides(n)[0]
    steps = F.sequence(F.lit(1), F.lit(a if a <= 8 else min(a, math.ceil(70 / math.log(a)))))

    def walk(x: Column) -> Column:
        back = F.aggregate(steps, x, lambda x, _: F.when(x < n, x).otherwise(_moved(x, n, keys)))
        return F.coalesce(F.when(back < n, back), F.raise_error(F.lit("a number did not come back into the range")).cast("long"))

    # One application for most numbers, worked out once.
    first = F.transform(F.array(_moved(i, n, keys)), lambda x: F.when(x < n, x).otherwise(walk(x)))
    return F.element_at(first, 1)


def permuted_sql(i: str, n: str, keys: list[int]) -> str:
    """The same as an expression of DuckDB."""
    a = f"CAST(floor(sqrt(greatest({n} - 1, 0))) AS BIGINT) + 1"
    b = f"(({n} + {a} - 1) // ({a}))"
    rounds = ", ".join(f"[{k % 2}, {key}]" for k, key in enumerate(keys))

    def scrambled(v: str) -> str:
        # As an own list step each, so that no number is written out more than twice.
        return f"list_reduce([CAST({v} AS BIGINT), r[2]], lambda v, k: xor(xor(v * 1664525 + k, (v * 1664525 + k) >> 13) % {_PRIME} * 22695477 + k, (xor(v * 1664525 + k, (v * 1664525 + k) >> 13) % {_PRIME} * 22695477 + k) >> 17))"

    def moved(x: str) -> str:
        halves = f"list_reduce([[CAST({x} AS BIGINT) // {b}, CAST({x} AS BIGINT) % {b}], {rounds}], lambda s, r: CASE WHEN r[1] = 1 THEN [s[1], (s[2] + {scrambled('s[1]')}) % {b}] ELSE [(s[1] + {scrambled('s[2]')}) % ({a}), s[2]] END)"
        return f"list_reduce([{halves}, [0, {b}]], lambda h, c: [h[1] * c[2] + h[2]])[1]"

    return f"list_reduce(list_prepend({moved(i)}, [0 for _ in range(8)]), lambda x, _: CASE WHEN x < {n} THEN x ELSE {moved('x')} END)"
