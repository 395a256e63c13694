"""De-novo alleles in trios from genotype likelihoods.

A site's score is the share of the best genotypes of father, mother and child that inheritance alone can't give, among all
combinations of their genotypes, each weighed by its likelihoods, by how common the parents' genotypes are, and by
transmission or mutation. The weights of all combinations are one tensor (father x mother x child) for a number of alleles
and a way of inheritance; the likelihoods of all trios of a batch are added to it by broadcasting.

Defined results: a trio with a null PL, or one whose length isn't that of the site's diploid genotypes, has no score; so has a site
without ALTs. Missing AD gives no share of reads. Trios come once for each row of the table that has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The chance of a mutation.
MUTATION = 1e-8
#: Fixed values of the published trio model: how often parents have REF only, by way of inheritance, and how the rest is
#: shared among one-ALT genotypes, by copies of REF (two of them in one or in both parents).
REF_ONLY = {"autosome": 0.998, "son": 0.999, "daughter": 0.998}
ONE_ALT = {"autosome": {3: 4 / 15, "2 in one": 2 / 15, 2: 4 / 15, 1: 4 / 15, 0: 1 / 15}, "son": {1: 2 / 3, 0: 1 / 3}, "daughter": {2: 3 / 7, 1: 3 / 7, 0: 1 / 7}}
#: And of genotypes with two ALTs (their share of the squared rest) and with more.
TWO_ALTS, MORE_ALTS = {"autosome": 1 / 57, "son": 1 / 3, "daughter": 1 / 27}, 1e-26


def genotypes(n: int) -> list[tuple[int, int]]:
    return [(a, b) for b in range(n) for a in range(b + 1)]


def parental_prior(f: tuple[int, int], m: tuple[int, int], way: str) -> float:
    """How common the parents' genotypes are. A son's X comes from the mother alone; a daughter's father has one X."""
    if way == "daughter" and f[0] != f[1]:
        return 0.0
    copies = {"autosome": [*f, *m], "son": [*m], "daughter": [f[0], *m]}[way]
    refs, alts = copies.count(0), {a for a in copies if a}
    rare = 1 - REF_ONLY[way]
    if not alts:
        return REF_ONLY[way]
    if len(alts) > 1:
        return MORE_ALTS if len(alts) > 2 else rare * rare * TWO_ALTS[way]
    key = "2 in one" if way == "autosome" and refs == 2 and m[0] == m[1] else refs
    return (1 - REF_ONLY[way] - rare * rare) * ONE_ALT[way][key] / 3  # any of three bases


def _autosomal(f: tuple[int, int], m: tuple[int, int], c: tuple[int, int], novel_only: bool) -> tuple[float, int]:
    """(transmission, mutated copies): the former is 0 for what can't be inherited."""
    a, b = c
    if novel_only:
        new = {x for x in c if x not in f and x not in m}
        strange = bool(new) and (a if a in new else b) != 0
    else:
        strange = not (a in f and b in m or a in m and b in f)
    if not strange:
        return 0.5 ** ((f[0] != f[1]) + (m[0] != m[1])), 0
    return 0.0, 1 if any(x in f or x in m for x in c) else 2


def transmission(f: tuple[int, int], m: tuple[int, int], c: tuple[int, int], way: str, novel_only: bool = False) -> tuple[float, int]:
    a, b = c
    if way == "son":
        if a == b:
            return (0.5 if m[0] != m[1] else 1.0, 0) if a in m else (0.0, 1)
        known = {*f, *m} if novel_only else {*m}
        # a son with two alleles of X that his parents have is an error of genotyping
        return (0.0, 1) if a not in known or b not in known else _autosomal(f, m, c, novel_only)
    if way == "daughter" and f[0] == f[1]:
        x = f[0]
        if a == x and b in m or b == x and a in m:
            return 0.5 if m[0] != m[1] else 1.0, 0
        return 0.0, 1 if any(y == x or y in m for y in c) else 2
    return _autosomal(f, m, c, novel_only)


@lru_cache(maxsize=64)
def weights(n: int, way: str, mutation: float = MUTATION, novel_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logs of the weights, whether a combination is de novo, and its new allele: father x mother x child genotypes."""
    g = genotypes(n)
    log, strange, allele = (np.zeros((len(g),) * 3, t) for t in (float, bool, int))
    for i, f in enumerate(g):
        for j, m in enumerate(g):
            prior = parental_prior(f, m, way)
            for k, c in enumerate(g):
                passed, copies = transmission(f, m, c, way, novel_only)
                w = prior * (passed * (1 - mutation) if not copies else mutation**copies)
                log[i, j, k] = np.log(w) if w > 0 else -np.inf
                strange[i, j, k] = passed == 0
                known = {*m} if way == "son" else {*f, *m}
                allele[i, j, k] = c[1] if c[1] not in known else c[0] if c[0] not in known else c[0]
    return log, strange, allele


def scores(father: np.ndarray, mother: np.ndarray, child: np.ndarray, n: int, way: str, mutation: float = MUTATION, novel_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Log scores and new alleles of trios x genotypes phred likelihoods."""
    log, strange, allele = weights(n, way, mutation, novel_only)
    f, m, c = (-np.log(10) / 10 * x for x in (father, mother, child))
    joint = f[:, :, None, None] + m[:, None, :, None] + c[:, None, None, :] + log
    flat = joint.reshape(len(joint), -1)
    top = flat.max(1)
    total = top + np.log(np.exp(flat - top[:, None]).sum(1))
    new = np.where(strange.ravel(), flat, -np.inf)
    best = new.argmax(1)
    return new[np.arange(len(new)), best] - total, allele.ravel()[best]


def de_novo(df: DataFrame, trios: list[tuple[int, int, int, str]], on_x: Column | None = None, mutation: float = MUTATION, novel_only: bool = False) -> DataFrame:
    """chrom, pos, ref, alts, trio, dnm (log score), allele, vaf for each of ``trios`` (child, father, mother, sex ``m`` or ``f``).

    ``on_x``: whether a site is on X outside the pseudo-autosomal regions. ``vaf``: the share of the child's reads with the
    allele. ``novel_only``: the allele has to be one that neither parent has.
    """
    t = F.array(*[F.struct(F.lit(i).alias("trio"), F.lit(c).alias("c"), F.lit(f).alias("f"), F.lit(m).alias("m"), F.lit("son" if sex == "m" else "daughter").alias("x")) for i, (c, f, m, sex) in enumerate(trios)])
    e = df.select("chrom", F.col("pos").cast("long").alias("pos"), "ref", "alts", "samples", F.coalesce(on_x, F.lit(False)).alias("_x") if on_x is not None else F.lit(False).alias("_x"), F.explode(t).alias("t"))
    pl = lambda who: F.transform(F.get("samples", F.col(f"t.{who}"))["PL"], lambda v: v.cast("double"))
    n = F.size(F.coalesce("alts", F.array().cast("array<string>"))) + 1
    fields = {f.name for f in df.schema["samples"].dataType.elementType.fields}
    ad = F.get("samples", F.col("t.c"))["AD"].cast("array<bigint>") if "AD" in fields else F.lit(None).cast("array<bigint>")
    e = e.select("chrom", "pos", "ref", "alts", F.col("t.trio").alias("trio"), n.alias("n"), F.when(F.col("_x"), F.col("t.x")).otherwise("autosome").alias("way"), pl("f").alias("f"), pl("m").alias("m"), pl("c").alias("c"), ad.alias("ad"))
    whole = lambda x: x.isNotNull() & (F.size(x) == F.col("n") * (F.col("n") + 1) / 2) & F.forall(x, lambda v: v.isNotNull())
    e = e.where((F.col("n") > 1) & whole(F.col("f")) & whole(F.col("m")) & whole(F.col("c")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, way = b.column("n").to_numpy(), np.array(b.column("way").to_pylist())
            score, allele = np.full(b.num_rows, -np.inf), np.zeros(b.num_rows, int)
            three = [(x.offsets.to_numpy(), x.flatten().to_numpy(zero_copy_only=False)) for x in (b.column(c) for c in "fmc")]
            for k in set(zip(size.tolist(), way.tolist(), strict=True)):
                rows, g = np.flatnonzero((size == k[0]) & (way == k[1])), k[0] * (k[0] + 1) // 2
                step = max(1, 4_000_000 // g**3)  # of the tensor, so many cells at once
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    score[some], allele[some] = scores(*(v[o[some][:, None] + np.arange(g)] for o, v in three), k[0], k[1], mutation, novel_only)
            vaf = [None if a is None or sum(a) == 0 or x >= len(a) else a[x] / sum(a) for a, x in zip((None if a is None or None in a else a for a in b.column("ad").to_pylist()), allele.tolist(), strict=True)]
            columns = [*(b.column(c) for c in ("chrom", "pos", "ref", "alts", "trio")), pa.array(score), pa.array(allele.astype(np.int32)), pa.array(vaf, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["chrom", "pos", "ref", "alts", "trio", "dnm", "allele", "vaf"])

    return e.mapInArrow(run, "chrom string, pos long, ref string, alts array<string>, trio int, dnm double, allele int, vaf double")
