"""Interval joins by bins.

Each interval goes to the bins that it touches; an equi-join on (contig, bin) meets candidates, and the exact test follows.
A pair that shares several bins is kept in the first shared one only, so no distinct is needed. Long intervals don't
explode without limit: they go to coarser bins of a hierarchy, each level eight times as wide as the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The finest bin is 2**BASE wide; a level is three bits wider than the one before.
BASE, LEVELS, STEP = 14, 6, 3
#: Bytes up to which the interval side is broadcast, by its counted rows and the width of its columns; it is counted first.
BROADCAST_BYTES = 32_000_000


def level_of(beg: Column, end: Column) -> Column:
    """The finest level at which an interval touches at most two bins."""
    out = F.lit(LEVELS - 1)
    for k in reversed(range(LEVELS - 1)):
        shift = BASE + STEP * k
        out = F.when(F.shiftright(end, shift) - F.shiftright(beg, shift) <= 1, k).otherwise(out)
    return out


def _shift(level: Column) -> Column:
    return F.element_at(F.array(*[F.lit(BASE + STEP * k) for k in range(LEVELS)]), level + 1)


def _bins(beg: Column, end: Column, level: Column) -> Column:
    width = F.element_at(F.array(*[F.lit(1 << (BASE + STEP * k)).cast("long") for k in range(LEVELS)]), level + 1)
    return F.sequence(F.floor(beg / width), F.floor(end / width))


def _probe_of(level: int):
    return lambda b: F.struct(F.lit(level).alias("level"), b.alias("bin"))


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    """A broadcast hint for tables of at most :data:`BROADCAST_BYTES`: rows and the bytes of their strings are summed first."""
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    if any(kind.startswith(("array", "map", "struct")) for _, kind in df.dtypes):
        return df
    size = df.select((F.count(F.lit(1)) * 16 * len(df.columns) + sum(text, F.lit(0))).alias("n")).first()["n"]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def overlap_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str] = ("chrom", "pos", "end"), right_on: tuple[str, str, str] = ("chrom", "beg", "end"), how: str = "inner", min_left: float = 0.0, min_right: float = 0.0) -> DataFrame:
    """Rows of ``left`` with the overlapping intervals of ``right`` (1-based, inclusive); right's columns get ``r_``.

    ``how``: inner, left, semi or anti. ``min_left`` and ``min_right``: the share of either that has to be covered.
    Only the distinct (contig, begin, end) of the left rows meet the intervals; the rows join what these have met by the
    same three columns, so wide rows are neither multiplied by bins nor numbered.
    """
    lc, lb, le = left_on
    rc, rb, re = right_on
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    r = r.withColumn("_level", level_of(F.col(f"r_{rb}"), F.col(f"r_{re}"))).withColumn("_bin", F.explode(_bins(F.col(f"r_{rb}"), F.col(f"r_{re}"), F.col("_level"))))
    keys = left.select(F.col(lc).alias("_c"), F.col(lb).alias("_b"), F.col(le).alias("_e")).distinct()
    # the left side probes its bins at every level
    probes = F.flatten(F.array(*[F.transform(_bins(F.col("_b"), F.greatest("_b", "_e"), F.lit(k)), _probe_of(k)) for k in range(LEVELS)]))
    shared = F.greatest(F.col("_b"), F.col(f"r_{rb}"))  # the first shared base lies in the first shared bin
    width = F.element_at(F.array(*[F.lit(1 << (BASE + STEP * k)).cast("long") for k in range(LEVELS)]), F.col("_level") + 1)
    common = F.least(F.col("_e"), F.col(f"r_{re}")) - shared + 1
    test = (F.col("_b") <= F.col(f"r_{re}")) & (F.col(f"r_{rb}") <= F.col("_e")) & (F.col("_bin") == F.floor(shared / width))
    if min_left:
        test = test & (common >= min_left * (F.col("_e") - F.col("_b") + 1))
    if min_right:
        test = test & (common >= min_right * (F.col(f"r_{re}") - F.col(f"r_{rb}") + 1))
    on = (F.col("_c") == F.col(f"r_{rc}")) & (F.col("_probe.level") == F.col("_level")) & (F.col("_probe.bin") == F.col("_bin")) & test
    probed = keys.withColumn("_probe", F.explode(probes))
    same = left[lc].eqNullSafe(F.col("_c")) & left[lb].eqNullSafe(F.col("_b")) & left[le].eqNullSafe(F.col("_e"))
    if how in ("semi", "anti"):
        narrow = r.select(f"r_{rc}", f"r_{rb}", f"r_{re}", "_level", "_bin").distinct()
        hit = probed.join(_maybe_broadcast(narrow), on, "left_semi").select("_c", "_b", "_e").distinct()
        return left.join(hit, same, f"left_{how}")
    met = probed.join(_maybe_broadcast(r), on).drop("_probe", "_level", "_bin")
    return left.join(met, same, "left" if how == "left" else "inner").drop("_c", "_b", "_e")


#: Bins of 2**POINTS bases for points in short intervals: few of either share a bin.
POINTS = 8


def point_join(left: DataFrame, right: DataFrame, left_on: tuple[str, str, str] = ("chrom", "pos", "end"), right_on: tuple[str, str] = ("chrom", "at")) -> DataFrame:
    """Rows of ``left`` with the points of ``right`` that lie in them; right's columns get ``r_``.

    For intervals that are short beside :data:`BASE` bins, as reads are. A point has one bin, so a pair meets once.
    """
    lc, lb, le = left_on
    rc, ra = right_on
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_bin", F.floor(F.col(f"r_{ra}") / (1 << POINTS)))
    probed = left.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lb) / (1 << POINTS)), F.floor(F.greatest(lb, le) / (1 << POINTS)))))
    on = (probed[lc] == F.col(f"r_{rc}")) & (probed["_bin"] == r["_bin"]) & (F.col(f"r_{ra}") >= F.col(lb)) & (F.col(f"r_{ra}") <= F.col(le))
    return probed.join(r, on).drop("_bin")


#: Positions are cut into blocks of 2**BLOCK bases where order matters only to the next site, so a contig is many tasks.
BLOCK = 20


def nearest(df: DataFrame, partition: str = "chrom", pos: str = "pos") -> DataFrame:
    """Distance to the previous and the next distinct position of the contig, and the lesser of both.

    Neighbours are found inside blocks of positions; a block's ends meet those of its neighbours in a table of one row
    a block.
    """
    from pyspark.sql import Window

    places = df.select(partition, pos).distinct().withColumn("_block", F.floor(F.col(pos) / (1 << BLOCK)))
    ends = places.groupBy(partition, "_block").agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    v = Window.partitionBy(partition).orderBy("_block")
    ends = ends.select(partition, "_block", F.lag("_hi").over(v).alias("_prev"), F.lead("_lo").over(v).alias("_next"))
    w = Window.partitionBy(partition, "_block").orderBy(pos)
    d = places.withColumn("_p", F.lag(pos).over(w)).withColumn("_n", F.lead(pos).over(w)).join(ends, [partition, "_block"])
    d = d.select(partition, pos, (F.col(pos) - F.coalesce("_p", "_prev")).alias("dist_prev"), (F.coalesce("_n", "_next") - F.col(pos)).alias("dist_next"))
    return df.join(d, [partition, pos]).withColumn("dist", F.least("dist_prev", "dist_next"))
