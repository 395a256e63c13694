"""Few sites that tell all samples apart: greedy cover of sample pairs, a job a choice.

A site tells a pair of samples apart if both have genotypes and these differ. Sites become rows of small genotype numbers,
written once. Each round, tasks compare all pairs of their sites at once (numpy over Arrow batches) with the pairs that are
not told apart yet, which the driver holds as bits (one for each pair of samples, however many sites there are), and give
their best site; the best of these is chosen. So the driver sees a row a task and a round, and rounds are as many as the
sites that are chosen.

Defined results: missing genotypes tell nothing; of sites that tell equally many new pairs the first by contig, position and
alleles is taken; phase and order of alleles don't matter; fewer than two samples, or no site that helps, give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.functions import genotype as g
from siteloom.sources.shared import stored

#: Cells of sites by pairs that a task compares at once.
CELLS = 8_000_000


def told_apart(codes: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """sites x pairs: whether the genotypes (-1: missing) of samples ``first`` and ``second`` differ."""
    a, b = codes[:, first], codes[:, second]
    return (a != b) & (a >= 0) & (b >= 0)


def distinctive_sites(df: DataFrame, enough: float = 1.0, blocks: int = 1) -> list[tuple[str, int, str, str, int, int]]:
    """(chrom, pos, ref, alts, pairs told apart so far, block) of the chosen sites.

    A block ends when ``enough`` pairs are told apart (a share up to 1, else a number) or no site helps; the next one
    begins anew without the sites that have been chosen.
    """
    key = F.transform("samples", lambda s: F.when(~g.is_missing(s["GT"]), F.array_join(F.transform(F.array_sort(s["GT"]["alleles"]), lambda a: a.cast("string")), "/")))
    t = df.select("chrom", F.col("pos").cast("long").alias("pos"), "ref", F.array_join("alts", ",").alias("alts"), key.alias("_k"))
    # numbers within the site: equal genotypes, equal numbers
    kinds = F.array_distinct(F.array_compact("_k"))
    t = t.select("chrom", "pos", "ref", "alts", F.transform("_k", lambda k: F.when(k.isNull(), -1).otherwise(F.array_position(kinds, k).cast("int"))).alias("codes")).where(F.size(F.array_distinct(F.filter("codes", lambda c: c >= 0))) > 1)
    t = stored(t, "genotype-codes")
    head = t.select(F.size("codes").alias("n")).first()
    if head is None or head["n"] < 2:
        return []
    samples = head["n"]
    first, second = np.triu_indices(samples, 1)
    least = int(np.ceil(len(first) * enough)) if enough <= 1 else min(int(enough), len(first))
    out, used = [], set()

    def best_site(left: np.ndarray) -> tuple | None:
        """The site that tells most of the pairs ``left`` apart, and how many."""
        a, b = first[left], second[left]
        gone = frozenset(used)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = None
            for batch in batches:
                codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, samples)
                step = max(1, CELLS // max(1, len(a)))
                n = np.concatenate([told_apart(codes[i : i + step], a, b).sum(1) for i in range(0, batch.num_rows, step)])
                for i in np.argsort(-n, kind="stable"):
                    if top is not None and n[i] < top[0]:
                        break
                    site = tuple(batch.column(c)[int(i)].as_py() for c in ("chrom", "pos", "ref", "alts"))
                    if site not in gone and n[i] and (top is None or (-n[i], site) < (-top[0], top[1])):
                        top = (int(n[i]), site)
            if top is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*top[1], top[0]), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["chrom", "pos", "ref", "alts", "n"])

        return t.mapInArrow(run, "chrom string, pos long, ref string, alts string, n long").orderBy(F.desc("n"), "chrom", "pos", "ref", "alts").first()

    def codes_of(site: tuple) -> np.ndarray:
        chrom, pos, ref, alts = site
        return np.array(t.where((F.col("chrom") == chrom) & (F.col("pos") == pos) & (F.col("ref") == ref) & (F.col("alts") == alts)).first()["codes"])

    for block in range(blocks):
        left = np.ones(len(first), bool)
        while left.size - left.sum() < least:
            row = best_site(np.flatnonzero(left))
            if row is None:
                break
            site = (row["chrom"], row["pos"], row["ref"], row["alts"])
            used.add(site)
            left &= ~told_apart(codes_of(site)[None], first, second)[0]
            out.append((*site, int(left.size - left.sum()), block))
        else:
            continue
        break
    return out
