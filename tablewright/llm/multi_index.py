"""Multi-index hashing: all pairs of 64-bit fingerprints within a Hamming distance.

A fingerprint is cut into segments, and every segment has a hash table of its own, whose buckets are
the segment's values (Norouzi, Punjani, Fleet, "Fast Search in Hamming Space with Multi-Index
Hashing", 2012). Of two fingerprints at distance r or less, some segment of m differs in at most
r // m bits, so a fingerprint fetches from every table the buckets of the small Hamming ball around its
segment; complete distances of what it fetches are verified.

A bucket of one segment grows with the corpus, and near copies share most segments. A bucket of more
than ``HOT`` fingerprints is therefore not fetched but split on the next segment: within it the other
m - 1 segments may differ in what is left of r, so again one of them differs in at most a small number
of bits, and its tables and balls are made inside the bucket alone. That repeats until buckets
are small or all segments are fixed, where a bucket is one fingerprint. A fetch
thus meets at most ``HOT`` fingerprints, however many there are or how alike.

Of two fingerprints whose segments differ, the one with the smaller value fetches.

At scale: per segment and level one row a fingerprint in the table, and one per ball member that
fetches; joins on the bucket alone, whose table side has at most ``HOT`` rows a key. Hot buckets are
counted before their shuffle. Every level is written to the shared folder.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import own_shuffle
from ..scratch import staged

BITS = 64
SEGMENTS = 4
WIDTH = BITS // SEGMENTS
#: Fingerprints a bucket may hold to be fetched.
HOT = 32
#: Greatest distance asked for, and members of a ball that is enumerated; a bucket of which all
#: but one segment is fixed, and whose ball would be larger, is compared as it is: it has at most
#: 2 ** WIDTH fingerprints, most of them that near.
MOST = 8
MOST_BALL = 5000


def ball(radius: int, width: int = WIDTH) -> list[int]:
    """The bits in which a segment's neighbours differ from it, itself (0) first."""
    return [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(width), n)]


def _numbers(values: list[int]) -> Column:
    """A constant array; as text, since thousands of literals make a slow plan."""
    return F.from_json(F.lit(f"[{','.join(map(str, values))}]"), "array<bigint>")


def _next_segments(rows: DataFrame) -> DataFrame:
    """A row for every segment that the bucket does not fix yet, as ``segment``."""
    unused = F.filter(F.sequence(F.lit(0), F.lit(SEGMENTS - 1)), lambda s: F.get(F.col("unused"), s))
    return rows.withColumn("segment", F.explode(unused))


_FIXED = "shiftleft({mask}L, segment * {width})".format(mask=(1 << WIDTH) - 1, width=WIDTH)
_PATH = f"path * {SEGMENTS + 1} + segment + 1"
_UNUSED = "transform(unused, (u, s) -> u and s <> segment)"


def _table(items: DataFrame) -> DataFrame:
    """(path, bits, unused, f): items in the buckets of their next segments."""
    return _next_segments(items).selectExpr(f"{_PATH} as path", f"bits | (f & {_FIXED}) as bits", f"{_UNUSED} as unused", "f")


def _fetches(probes: DataFrame, left: int, most: int) -> DataFrame:
    """(path, bits, unused, f, rest): the buckets that the items fetch, and what may still differ.

    ``left`` segments are not fixed yet.
    """
    members = _next_segments(probes).withColumn("flip", F.explode(_numbers(ball(most // left))))
    members = members.filter(f"bit_count(flip) <= rest div {left}").selectExpr(
        "*", f"f ^ shiftleft(flip, segment * {WIDTH}) as member", f"{_FIXED} as fixed"
    )
    # while nothing differs yet, the smaller of two values fetches
    ahead = f"shiftrightunsigned(member & fixed, segment * {WIDTH}) >= shiftrightunsigned(f & fixed, segment * {WIDTH})"
    return members.filter(f"rest < {most} or {ahead}").selectExpr(
        f"{_PATH} as path", "bits | (member & fixed) as bits", f"{_UNUSED} as unused", "f", "cast(rest - bit_count(flip) as int) as rest"
    )


def _meet(fetches: DataFrame, table: DataFrame, most: int) -> DataFrame:
    """(a, b) of what lies in a fetched bucket and is near enough, the lesser first."""
    met = fetches.select("path", "bits", F.col("f").alias("a"), "rest").join(table.select("path", "bits", F.col("f").alias("b")), ["path", "bits"])
    # where nothing differs so far both fetch each other
    once = ((F.col("rest") < most) & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b"))
    near = met.filter(once & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_pairs(fingerprints: DataFrame, column: str, most: int = 2, hot: int = HOT) -> DataFrame:
    """(a, b): every pair of different fingerprints at distance ``most`` or less, once.

    ``fingerprints`` has every value once, as a signed 64-bit number.
    """
    if not 0 <= most <= MOST:
        raise ValueError(f"distances of 0 to {MOST} bits are supported, not {most}")
    start = fingerprints.select(
        F.lit(0).alias("path"), F.lit(0).cast("bigint").alias("bits"), F.array_repeat(F.lit(True), SEGMENTS).alias("unused"), F.col(column).alias("f")
    )
    items, probes, found = start, start.withColumn("rest", F.lit(most)), []
    for left in range(SEGMENTS, 0, -1):
        if left == 1 and len(ball(most)) > MOST_BALL:
            found.append(staged(_meet(probes, items, most), "pairs"))
            break
        table, fetches = staged(_table(items), "table"), staged(_fetches(probes, left, most), "fetches")
        if left == 1:  # a bucket is one fingerprint
            found.append(staged(_meet(fetches, table, most), "pairs"))
            break
        large = table.groupBy("path", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot).select("path", "bits")
        large = staged(large, "large")
        if large.isEmpty():
            found.append(staged(_meet(fetches, table, most), "pairs"))
            break
        large = own_shuffle(large)
        # the table alone decides: what fetches a large bucket finds nothing among the small ones
        found.append(staged(_meet(fetches, table.join(large, ["path", "bits"], "left_anti"), most), "pairs"))
        items = staged(table.join(large, ["path", "bits"], "left_semi"), "items")
        probes = staged(fetches.join(large, ["path", "bits"], "left_semi"), "probes")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs.distinct()
