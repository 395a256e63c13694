"""Order-dependent operators: runs, blocks, moving averages, thinning, linkage, overlap removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import genotype as g
from siteloom.operators.carried import RANGE, carried, in_blocks, ranged
from siteloom.sources.shared import stored


def reference_blocks(df: DataFrame, bands: list[int], sample: int = 0) -> DataFrame:
    """Runs of consecutive homozygous-reference sites in one band of depth become blocks; other rows break runs.

    A block has chrom, beg, end, min_dp, n; a gap, a change of band and a variant start a new one.
    """
    s = F.get("samples", F.lit(sample))
    hom_ref = ~g.is_missing(s["GT"]) & ~g.has_alt(s["GT"])
    band = F.lit(-1)
    for k, lo in enumerate(bands):
        band = F.when(s["DP"] >= lo, k).otherwise(band)
    t = df.select("chrom", "pos", F.coalesce("end", "pos").alias("end"), s["DP"].alias("dp"), F.when(hom_ref, band).otherwise(-2).alias("band"))
    t = carried(ranged(t, ["chrom"], ["pos"]), ["chrom"], ["pos"], before={"_band": F.col("band"), "_end": F.col("end")})
    new = (F.col("band") != F.col("_band")) | (F.col("pos") > F.col("_end") + 1) | (F.col("band") < 0)
    t = carried(t, ["chrom"], ["pos"], sums={"run": F.coalesce(new, F.lit(True)).cast("int")}).where("band >= 0")
    return t.groupBy("chrom", "run").agg(F.min("pos").alias("beg"), F.max("end").alias("end"), F.min("dp").alias("min_dp"), F.count(F.lit(1)).alias("n"), F.first("band").alias("band")).drop("run")


def expand_blocks(blocks: DataFrame, others: list[str] | None = None) -> DataFrame:
    """One row a position; a block ends where the next one starts."""
    t = carried(ranged(blocks, ["chrom"], ["beg"]), ["chrom"], ["beg"], after={"_next": F.col("beg")})
    stop = F.least(F.col("end"), F.coalesce(F.col("_next") - 1, F.col("end")))
    return t.withColumn("_stop", stop).where("_stop >= beg").select("chrom", F.explode(F.sequence("beg", "_stop")).alias("pos"), *(others or []))


def runs_by(df: DataFrame, label: Column, partition: str, order: list[str]) -> DataFrame:
    """Re-blocking by any label: consecutive rows of one label are a run."""
    t = ranged(df.select(partition, *order, label.alias("_label")), [partition], order)
    t = carried(t, [partition], order, before={"_last": F.col("_label")}, sums={"_rows": F.lit(1)})
    new = (F.col("_rows") == 1) | ~F.col("_label").eqNullSafe(F.col("_last"))
    t = carried(t, [partition], order, sums={"_run": new.cast("int")})
    return t.groupBy(partition, "_run").agg(F.first("_label").alias("label"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count(F.lit(1)).alias("n")).drop("_run")


def moving_average(df: DataFrame, value: str, width: int, partition: str = "chrom", order: str = "pos", block: int = 1 << 16) -> DataFrame:
    """Mean over the rows i - width//2 .. i + width - width//2 - 1, cut at the ends.

    Rows are numbered along the whole; blocks of row numbers, with the rows that they reach, are averaged apart.
    """
    back, ahead = width // 2, width - width // 2 - 1
    t = carried(ranged(df, [partition], [order]), [partition], [order], sums={"_n": F.lit(1)})
    t = in_blocks(t, F.col("_n"), back, ahead, max(block, 2 * width))
    w = Window.partitionBy(partition, "_block").orderBy("_n").rowsBetween(-back, ahead)
    return t.withColumn("mean", F.avg(value).over(w)).where("_own").drop("_n", "_block", "_own", RANGE)


def window_counts(df: DataFrame, width: int, block: int = 1 << 20) -> DataFrame:
    """The largest number of sites that any window of ``width`` bases has that holds the site.

    A window starts at a site. Its population is a range count; a site's answer is the maximum over the windows that
    start at most ``width - 1`` before it, a range maximum. Blocks of positions, with the sites that they reach, are
    counted apart.
    """
    t = in_blocks(df, F.col("pos"), width - 1, width - 1, max(block, 2 * width))
    ahead = Window.partitionBy("chrom", "_block").orderBy("pos").rangeBetween(0, width - 1)
    back = Window.partitionBy("chrom", "_block").orderBy("pos").rangeBetween(-(width - 1), 0)
    return t.withColumn("_n", F.count(F.lit(1)).over(ahead)).withColumn("n_in_window", F.max("_n").over(back)).where("_own").drop("_n", "_block", "_own")


def duplicates(df: DataFrame) -> DataFrame:
    """All sites whose position occurs more than once get ``dup``."""
    return df.withColumn("dup", F.count(F.lit(1)).over(Window.partitionBy("chrom", "pos")) > 1)


def overlaps(df: DataFrame) -> DataFrame:
    """Sites whose interval meets that of another get ``overlap``: from the running end of those before, and the start after."""
    end = F.col("pos") + F.length("ref") - 1
    t = ranged(df.withColumn("_end", end).withColumn("_alt", F.array_join("alts", ",")), ["chrom"], ["pos", "ref", "_alt"])
    t = carried(t, ["chrom"], ["pos", "ref", "_alt"], maxima={"_before": F.col("_end")}, after={"_after": F.col("pos")}, inclusive=False)
    hit = F.coalesce(F.col("_before") >= F.col("pos"), F.lit(False)) | F.coalesce(F.col("_after") <= F.col("_end"), F.lit(False))
    return t.withColumn("overlap", hit).drop("_end", "_alt", "_before", "_after", RANGE)


def _range_maxima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The greatest of ``values[lo:hi]`` for each pair, -1 if there is none."""
    out, size = np.full(len(lo), -1, np.int64), hi - lo
    level, table, k = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1), values, 0
    while k <= level.max(initial=-1):
        some = level == k
        out[some] = np.maximum(table[lo[some]], table[hi[some] - (1 << k)])
        table, k = np.maximum(table[: -(1 << k)], table[1 << k :]), k + 1
    return out


def _painted(n: int, lo: np.ndarray, hi: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each of ``n`` places the greatest of the values whose range ``lo:hi`` has it, -1 if none has."""
    out, size = np.full(n, -1, np.int64), hi - lo
    level = np.where(size > 0, np.frexp(np.maximum(size, 1))[1] - 1, -1)
    for k in range(int(level.max(initial=-1)), -1, -1):
        # out[x] stands for the 2**k places from x on
        some = level == k
        np.maximum.at(out, lo[some], values[some])
        np.maximum.at(out, hi[some] - (1 << k), values[some])
        if k:
            half, out = out, out.copy()
            out[1 << k - 1 :] = np.maximum(out[1 << k - 1 :], half[: -(1 << k - 1)])
    return out


#: Levels of nodes, each twice as wide as the one before, that stand for runs of blocks.
_NODES = 48


def _nodes(first: Column, last: Column) -> Column:
    """The nodes (level, node) that the blocks ``first`` to ``last`` are made of, two of a level at most."""
    start = F.struct(first.cast("long").alias("a"), (last + 1).cast("long").alias("b"), F.array().cast("array<struct<level:int,node:bigint>>").alias("out"))

    def step(acc: Column, level: Column) -> Column:
        odd_a, odd_b = (acc["a"] < acc["b"]) & (F.pmod(acc["a"], F.lit(2)) == 1), (acc["a"] < acc["b"]) & (F.pmod(acc["b"], F.lit(2)) == 1)
        found = F.array_compact(F.array(F.when(odd_a, F.struct(level.alias("level"), acc["a"].alias("node"))), F.when(odd_b, F.struct(level.alias("level"), (acc["b"] - 1).alias("node")))))
        return F.struct(F.shiftright(acc["a"] + odd_a.cast("long"), 1).alias("a"), F.shiftright(acc["b"] - odd_b.cast("long"), 1).alias("b"), F.concat(acc["out"], found).alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(_NODES)), start, step, lambda acc: acc["out"])


def best_non_overlapping(df: DataFrame, block: int = 1 << 17) -> DataFrame:
    """Rows by ascending QUAL are removed while they still overlap another; missing QUAL counts 0. ``removed`` tells.

    A row removed before another would have been met by it, so a row goes if and only if a row that comes later (by QUAL,
    position, REF, ALT) overlaps it; of equal rows one stays. Blocks of positions are solved apart, by maxima over ranges
    of the rows in order; a row that ends in a later block is a guest there. Blocks wholly within a row are told by nodes
    (runs of 1, 2, 4... blocks), so a row of any length is a few rows, and no chain of rows has to be in one task. An
    empty REF counts as one base; rows without a position or REF overlap nothing.
    """
    reach = F.col("pos") + F.greatest(F.length("ref"), F.lit(1)) - 1
    t = df.select("chrom", F.col("pos").cast("long").alias("pos"), reach.cast("long").alias("_reach"), "ref", F.array_join("alts", ",").alias("alt"), F.coalesce(F.col("qual").cast("double"), F.lit(0.0)).alias("q"))
    t = t.withColumns({"_c": F.coalesce(F.concat(F.lit("="), "chrom"), F.lit("")), "_block": F.floor(F.col("pos") / block), "_last": F.floor(F.col("_reach") / block)})
    t = stored(t, "overlaps")
    placed, row = t.where("_reach is not null"), ["chrom", "pos", "ref", "alt", "q"]
    own, guest, cover = 0, 1, 2
    met = placed.withColumn("_kind", F.lit(own)).unionByName(placed.where("_last > _block").withColumn("_block", F.col("_last")).withColumn("_kind", F.lit(guest))).drop("_last")
    beaten = None
    long = placed.where("_last > _block + 1")
    if not long.isEmpty():
        key = F.struct("q", "pos", "ref", F.col("alt").isNull().alias("none"), "alt")
        above = F.explode(F.transform(F.sequence(F.lit(0), F.lit(_NODES)), lambda k: F.struct(k.alias("level"), F.floor(F.col("_block") / F.pow(F.lit(2.0), k)).alias("node"))))
        spans = long.groupBy("_c", "_block", "_last").agg(F.max(key).alias("_key")).withColumn("_node", F.explode(_nodes(F.col("_block") + 1, F.col("_last") - 1))).select("_c", "_block", "_last", "_key", "_node.*")
        covers = spans.groupBy("_c", "level", "node").agg(F.max("_key").alias("_key"))
        blocks = placed.groupBy("_c", "_block").agg(F.max(key).alias("_best")).withColumn("_node", above).select("_c", "_block", "_best", "_node.*")
        over = blocks.join(covers, ["_c", "level", "node"]).groupBy("_c", "_block").agg(F.max("_key").alias("k"))
        met = met.unionByName(over.select(F.lit(None).cast("string").alias("chrom"), "k.pos", F.col("k.pos").alias("_reach"), "k.ref", "k.alt", "k.q", "_c", "_block", F.lit(cover).alias("_kind")))
        best = blocks.groupBy("_c", "level", "node").agg(F.max("_best").alias("_best"))
        within = spans.drop("_key").join(best, ["_c", "level", "node"]).groupBy("_c", "_block", "_last").agg(F.max("_best").alias("_best"))
        beaten = long.join(within, ["_c", "_block", "_last"]).where(F.col("_best") > key).select(*row, F.lit(False).alias("own"), F.lit(True).alias("beaten"))

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        place = lambda c: np.where((k := pd.factorize(p[c], sort=True)[0]) < 0, len(p), k)
        keys = np.stack([place("alt"), place("ref"), p["pos"].to_numpy(), np.unique(p["q"].to_numpy(), return_inverse=True)[1].ravel()])
        by = np.lexsort(keys)
        rank = np.empty(len(p), np.int64)
        rank[by] = np.cumsum(np.r_[False, (np.diff(keys[:, by], axis=1) != 0).any(0)])
        kind, beg, end = p["_kind"].to_numpy(), p["pos"].to_numpy(), p["_reach"].to_numpy()
        mine = np.flatnonzero(kind == own)
        mine = mine[np.argsort(beg[mine], kind="stable")]
        # the own rows that begin within each row
        lo = np.where(kind == own, np.searchsorted(beg[mine], beg, "left"), 0)
        hi = np.where(kind == cover, len(mine), np.searchsorted(beg[mine], end, "right"))
        beaten = (_range_maxima(rank[mine], lo, hi) > rank) & (kind != cover)
        beaten[mine] |= _painted(len(mine), lo, hi, rank) > rank[mine]
        return p.assign(own=kind == own, beaten=beaten).loc[kind != cover, [*row, "own", "beaten"]]

    schema = "chrom string, pos long, ref string, alt string, q double, own boolean, beaten boolean"
    out = met.groupBy("_c", "_block").applyInPandas(solve, schema)
    out = out.unionByName(beaten) if beaten is not None else out
    out = out.groupBy(*row).agg(F.count_if("own").alias("n"), F.bool_or("beaten").alias("beaten"))
    out = out.select("chrom", "pos", "ref", "alt", "beaten", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i")).select("chrom", "pos", "ref", "alt", (F.col("beaten") | (F.col("i") > 1)).alias("removed"))
    return out.unionByName(t.where("_reach is null").select("chrom", "pos", "ref", "alt", F.lit(False).alias("removed")))


def thinned(df: DataFrame, n: int, width: int, by: Column | None = None) -> DataFrame:
    """At most ``n`` sites in each of the fixed windows of ``width`` bases, the highest ``by`` first, else the first."""
    t = df.withColumn("_w", F.floor(F.col("pos") / width)).withColumn("_by", by if by is not None else F.lit(0))
    w = Window.partitionBy("chrom", "_w").orderBy(F.desc_nulls_last("_by"), "pos", "ref")
    return t.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n", "_w", "_by")


def slid(pos: list[int], rank: list[float] | None, n: int, width: int) -> list[int]:
    """Places of the sites that a sliding window keeps: as soon as a site lies ``width`` bases or more behind the first one held, the
    sites before it are cut down to ``n`` (those of the lowest ``rank`` go, else the last ones), and the first is let go."""
    held, kept = [], []

    def cut(sites: list[int]) -> list[int]:
        if len(sites) <= n:
            return sites
        if rank is None:
            return sites[:n]
        return sorted(sorted(sites, key=lambda k: rank[k])[len(sites) - n :])

    for k, p in enumerate(pos):
        while held and p - pos[held[0]] >= width:
            held = cut(held)
            kept.append(held.pop(0))
        held.append(k)
    while held:
        held = cut(held)
        kept.append(held.pop(0))
    return kept


def pruned(df: DataFrame, n: int, width: int, by: Column | None = None) -> DataFrame:
    """At most ``n`` sites in a window of ``width`` bases that slides over each contig (:func:`slid`).

    Where two sites are ``width`` bases or more apart the window empties, so each chain of closer sites is solved apart.
    """
    keys = ["chrom", "pos", "ref", "alt"]
    t = df.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), (by if by is not None else F.lit(None)).cast("double").alias("_by"))
    order = ["pos", "ref", "alt"]
    t = carried(ranged(t, ["chrom"], order), ["chrom"], order, before={"_last": F.col("pos")})
    t = carried(t, ["chrom"], order, sums={"_chain": F.coalesce((F.col("pos") - F.col("_last") >= width).cast("int"), F.lit(1))})
    ranked = by is not None

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["pos", "ref", "alt"])
        return p.iloc[slid(p["pos"].tolist(), p["_by"].fillna(0).tolist() if ranked else None, n, width)][keys]

    stays = t.select("chrom", "pos", "ref", "alt", "_by", "_chain").groupBy("chrom", "_chain").applyInPandas(solve, "chrom string, pos long, ref string, alt string")
    return df.withColumn("alt", F.array_join("alts", ",")).join(stays, keys, "left_semi").drop("alt")


def ld_statistics(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """(r2, D', RD) of two sites' dosages; NaN entries are missing."""
    ok = ~np.isnan(x) & ~np.isnan(y)
    x, y = x[ok], y[ok]
    if len(x) < 2:
        return 0.0, 0.0, 0.0
    px, py = x.mean() / 2, y.mean() / 2
    cov = ((x - x.mean()) * (y - y.mean())).mean()
    vx, vy = x.var(), y.var()
    r2 = cov * cov / (vx * vy) if vx > 0 and vy > 0 else 1.0 if (x == y).all() else 0.0
    d = cov / 2
    top = min(px * (1 - py), (1 - px) * py) if d >= 0 else min(px * py, (1 - px) * (1 - py))
    return float(r2), float(abs(d) / top) if top > 0 else 0.0, float(d)


def ld_annotated(df: DataFrame, n_before: int) -> DataFrame:
    """chrom, pos, r2, r2_pos: the largest squared correlation with one of the ``n_before`` sites before, and which.

    Sites are numbered along the contig; blocks of numbers, with the sites that they reach, are solved apart, and a frame
    of rows gives each site the dosages before it.
    """
    d = F.transform("samples", lambda s: F.coalesce(g.dosage(s["GT"]).cast("double"), F.lit(float("nan"))))
    t = df.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), d.alias("d"))
    order = ["pos", "ref", "alt"]
    t = carried(ranged(t, ["chrom"], order), ["chrom"], order, sums={"_n": F.lit(1)})
    t = in_blocks(t, F.col("_n"), n_before, 0, max(1 << 12, 2 * n_before))
    w = Window.partitionBy("chrom", "_block").orderBy("_n").rowsBetween(-n_before, -1)
    t = t.select("chrom", "pos", "d", "_own", F.collect_list(F.struct("pos", "d")).over(w).alias("before")).where("_own").drop("_own")

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for x, before in zip(p["d"], p["before"], strict=True):
                best, where = None, None
                for b in before:
                    r2 = ld_statistics(np.asarray(x, float), np.asarray(b["d"], float))[0]
                    if best is None or r2 > best:
                        best, where = r2, b["pos"]
                out.append((best, where))
            yield pd.DataFrame({"chrom": p["chrom"], "pos": p["pos"], "r2": [o[0] for o in out], "r2_pos": pd.array([o[1] for o in out], dtype="Int64")})

    return t.mapInPandas(score, "chrom string, pos long, r2 double, r2_pos long")


def ld_pruned(df: DataFrame, most: float, width: int) -> DataFrame:
    """Greedy pruning: a site goes if its r2 with a site kept before, within ``width`` bases, is above ``most``.

    Sites further apart than ``width`` never meet, so each chain of closer sites is solved apart.
    """
    d = F.transform("samples", lambda s: F.coalesce(g.dosage(s["GT"]).cast("double"), F.lit(float("nan"))))
    t = df.select("chrom", "pos", "ref", F.array_join("alts", ",").alias("alt"), d.alias("d"))
    order = ["pos", "ref", "alt"]
    t = carried(ranged(t, ["chrom"], order), ["chrom"], order, before={"_last": F.col("pos")})
    t = carried(t, ["chrom"], order, sums={"_block": F.coalesce((F.col("pos") - F.col("_last") > width).cast("int"), F.lit(1))})

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["pos", "ref", "alt"])
        kept: list[tuple[int, np.ndarray]] = []
        ok = []
        for pos, x in zip(p["pos"], p["d"], strict=True):
            x = np.asarray(x, float)
            kept = [k for k in kept if pos - k[0] <= width]
            good = all(ld_statistics(k[1], x)[0] <= most for k in kept)
            ok.append(good)
            if good:
                kept.append((pos, x))
        return p.loc[ok, ["chrom", "pos", "ref", "alt"]]

    return t.select("chrom", "pos", "ref", "alt", "d", "_block").groupBy("chrom", "_block").applyInPandas(solve, "chrom string, pos long, ref string, alt string")
