"""Global sort, signed and unsigned, positions in sort order and the sortedness check.

A sort is a range exchange and a spilling sort of every partition.  Numbering
and checking work on ranges too, never on all rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brindle.kinds import position

_SIGN = -(1 << 63)
#: Different rows that numbering wants in a range, and the most ranges that it makes.
RANGE_ROWS, MOST_RANGES = 1 << 18, 1 << 12
#: Equal rows that one task gives their places.
EQUAL_ROWS = 1 << 20
#: Types whose equal values are one value.
GROUPED = frozenset("byte short integer long string boolean date timestamp timestamp_ntz binary decimal".split())
#: Rows that one window of the sortedness check spans.
CHECK_ROWS = 1 << 20


def unsigned(column: Column) -> Column:
    """A long that orders as the unsigned reading of a 64-bit column."""
    return column.cast("long").bitwiseXOR(F.lit(_SIGN))


def sort(df: DataFrame, column: int | str, descending: bool = False, memory_mb: int | None = None) -> DataFrame:
    """All rows (duplicates too) in order of a column.

    ``memory_mb`` is advisory: Spark's memory settings decide when to spill.
    """
    c = F.col(f"`{df.columns[position(df, column)]}`")
    return df.orderBy(c.desc() if descending else c.asc())


def sort_by(df: DataFrame, key: Column, descending: bool = False) -> DataFrame:
    """All rows in order of a key expression (a caller's own comparison)."""
    return df.orderBy(key.desc() if descending else key.asc())


def sort_unsigned(df: DataFrame, column: int | str, descending: bool = False) -> DataFrame:
    """All rows in order of the unsigned reading of a 64-bit column."""
    return sort_by(df, unsigned(F.col(f"`{df.columns[position(df, column)]}`")), descending)


def numbered(df: DataFrame, key: Column, descending: bool = False, name: str = "pos") -> DataFrame:
    """``df`` with the place (from 1) of each row in order of a numeric key.

    Equal rows are counted first, so that a row that occurs very often is one
    row to sort; its places are made afterwards, in parts.  The different rows
    are cut into ranges of the key at approximate quantiles, rows of one key
    that fill several ranges by a hash; places are counted in each range and
    shifted by the rows of the ranges before it.  Frames with columns that
    grouping would change (doubles: -0.0) or can't compare keep all rows.
    """
    plain = df.columns
    held = df.withColumn("_key", key)
    if all(f.dataType.typeName() in GROUPED for f in held.schema):
        held = held.groupBy(*held.columns).agg(F.count("*").alias("_n"))
    else:
        held = held.withColumn("_n", F.lit(1).cast("long"))
    rows = held.count()
    ranges = min(MOST_RANGES, rows // RANGE_ROWS + 1)
    cuts = held.agg(F.percentile_approx("_key", [k / ranges for k in range(1, ranges)], 4 * ranges)).first()[0] if ranges > 1 else []
    ranged = held.withColumn("_range", _range_of(F.col("_key"), cuts or [], [c for c in plain]))
    sign = -1 if descending else 1
    # at most 2 * MOST_RANGES rows
    sizes = sorted((sign * r["_range"], r["_range"], r["n"]) for r in ranged.groupBy("_range").agg(F.sum("_n").alias("n")).collect())
    before, total = [0] * (2 * len(cuts or []) + 1), 0
    for _, k, n in sizes:
        before[k], total = total, total + n
    ahead = F.sum("_n").over(Window.partitionBy("_range").orderBy(F.col("_key").desc() if descending else F.col("_key").asc(), *plain).rowsBetween(Window.unboundedPreceding, -1))
    # the range is an index of a constant array
    first = F.coalesce(ahead, F.lit(0)) + F.element_at(F.lit(before).cast("array<bigint>"), F.col("_range") + 1)
    placed = ranged.withColumn("_first", first)
    parts = placed.select(*plain, "_first", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / EQUAL_ROWS))).alias("_part"))
    low = F.col("_first") + F.col("_part") * EQUAL_ROWS
    high = F.least(low + EQUAL_ROWS, F.col("_first") + F.col("_n"))
    return parts.select(*plain, F.explode(F.sequence(low + 1, high)).alias(name))


def _range_of(key: Column, cuts: list, columns: list[str]) -> Column:
    """Range of a key among cuts, found in two steps; even: between cuts, odd: at a cut that occurs often.

    A key that fills several ranges is cut several times: its rows go to the
    ranges of those cuts by a hash of the row.
    """
    if not cuts:
        return F.lit(0)
    # place of a key: 2 * (cuts below it), plus 1 per equal cut passed by the hash
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.lit(cuts[::step])
    fine = F.lit([cuts[k : k + step] for k in range(0, len(cuts), step)])

    def below(reach) -> Column:
        """Number of cuts that ``reach`` (a comparison with the key) takes."""
        whole = F.size(F.filter(coarse, lambda c: reach(c)))
        inner = F.size(F.filter(F.element_at(fine, F.greatest(whole, F.lit(1))), lambda c: reach(c)))
        return F.when(whole == 0, F.lit(0)).otherwise((whole - 1) * step + inner)

    low, high = below(lambda c: c < key), below(lambda c: c <= key)
    # keys at no cut: 2 * low; rows of a cut key: one of the odd places between
    return F.when(high > low, 2 * low + 1 + 2 * F.pmod(F.xxhash64(*columns), high - low)).otherwise(2 * low).cast("int")


def is_sorted(df: DataFrame, column: int | str, place: str, strict: bool = False) -> DataFrame:
    """One row, ``is_sorted``: whether the column ascends in order of ``place``.

    ``place`` numbers the rows (a tuple id).  Each window of CHECK_ROWS places
    is checked by itself, then the edges of neighbouring windows.  Without
    ``strict``, equal neighbours are in order; no rows at all are sorted.
    """
    c = df.columns[position(df, column)]
    held = df.select(F.col(f"`{c}`").alias("v"), F.col(place).alias("p")).withColumn("w", F.floor(F.col("p") / CHECK_ROWS))
    ahead = F.lag("v").over(Window.partitionBy("w").orderBy("p"))
    rises = lambda a, b: F.coalesce((a < b) if strict else (a <= b), F.lit(True))
    parts = held.withColumn("ok", rises(ahead, F.col("v"))).groupBy("w").agg(F.bool_and("ok").alias("ok"), F.min_by("v", "p").alias("head"), F.max_by("v", "p").alias("tail"))
    edges = parts.withColumn("ok", F.col("ok") & rises(F.lag("tail").over(Window.orderBy("w")), F.col("head")))
    return edges.agg(F.coalesce(F.bool_and("ok"), F.lit(True)).alias("is_sorted"))
