"""Bit-vector distances against dynamic programming, and indels of reads."""

import random

import numpy as np
import pyarrow as pa
import pytest

from siteloom.operators import indels, ranges


def plain_distance(pattern, text):
    """The least edit distance to any piece of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            same = p == t and p in "ACGT"
            new.append(min(row[j - 1] + (not same), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("seed", range(4))
def test_distances_equal_dynamic_programming(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ACGT" if r.random() < 0.97 else "ACGTN") for _ in range(n))
    pairs = [(word(n), word(r.randint(0, 90))) for n in (0, 1, 2, 63, 64, 65, 127, 128, 129, 200) for _ in range(6)]
    for _ in range(60):  # near ones
        text = word(r.randint(50, 250))
        a = r.randint(0, 30)
        pattern = list(text[a : a + r.randint(10, 150)])
        for _ in range(r.randint(0, 6)):
            k = r.randrange(max(1, len(pattern)))
            pattern[k : k + r.randint(0, 2)] = list(word(r.randint(0, 3)))
        pairs.append(("".join(pattern), text))
    got = indels.edit_distances([p.encode() for p, _ in pairs], [t.encode() for _, t in pairs])
    assert got.tolist() == [plain_distance(p, t) for p, t in pairs]
    assert indels.edit_distances([], []).tolist() == [] and indels.edit_distances([b"ACG"], [b""]).tolist() == [3]


def test_worth_of_indels():
    assert indels.worth(-1, 1) == 40 and indels.worth(3, 2) == 80 and indels.worth(1, 10) == 50 - 10 and indels.worth(-1, 20) == 25
    assert indels.run_length("ACCCT", 0) == 3 and indels.run_length("AC", 1) == 0


def reads_frame(spark, rows):
    return spark.createDataFrame(rows, "chrom string, pos long, sample string, cigar string, seq string, reverse boolean")


def test_reads_that_hide_an_indel_are_found(spark):
    """Half of one sample's reads lack two bases; some of them are aligned without a gap and still count for the deletion."""
    r = random.Random(8)
    ref = "".join(r.choice("ACGT") for _ in range(200))
    chunks = spark.createDataFrame([("1", k, ref[k * 32 : k * 32 + 32]) for k in range(7)], "chrom string, chunk long, seq string")
    at = 100  # the base before, from 1
    ref = ref[:at] + "GTCA" + ref[at + 4 :] if ref[at] == ref[at + 2] else ref
    chunks = spark.createDataFrame([("1", k, ref[k * 32 : k * 32 + 32]) for k in range(7)], "chrom string, chunk long, seq string")
    gone = ref[:at] + ref[at + 2 :]
    rows = [("1", 71, "a", "30M2D28M", ref[70:100] + ref[102:130], k % 2 == 0) for k in range(6)]
    rows += [("1", 51, "a", "60M", gone[50:110], k % 2 == 0) for k in range(5)]  # its end would need the gap
    rows += [("1", 61, "a", "70M", ref[60:130], k % 2 == 0) for k in range(10)]
    rows += [("1", 61, "b", "70M", ref[60:130], None) for k in range(12)]
    rows += [("1", 61, "c", "40M3I30M", ref[60:100] + "TTT" + ref[100:130], True)]
    rows += [("1", 61, None, "70M", ref[60:130], False), ("1", 61, "a", "10M5N5M", ref[:15], False), (None, 61, "a", "5M", "ACGTA", False), ("1", 61, "a", None, "A", False), ("1", 61, "a", "5M", None, False), ("1", 61, "a", "5M", "ACG", False)]
    results = []
    for k in (1, 6):
        out = indels.indel_sites(reads_frame(spark, rows).repartition(k), chunks, 32, ["a", "b", "none"]).collect()
        results.append(list(map(str, out)))
        assert len(out) == 1
        x = out[0]
        assert (x.pos, x.ref) == (100, ref[99:102]) and x.alts[0] == ref[99] and x.info.IDV == 6 and x.info.IMF == 1.0  # the one read of c
        a, b, none = x.samples
        assert a.AD[0] == 10 and a.AD[1] == 11 and b.AD == [12] + [0] * len(x.alts)
        assert a.PL[1] == 0 and min(a.PL[0], a.PL[2]) > 30 and b.PL[0] == 0 and none.PL is None
    assert results[0] == results[1]
    assert indels.indel_sites(reads_frame(spark, rows).where("false"), chunks, 32, ["a"]).count() == 0
    assert indels.indel_sites(reads_frame(spark, rows), chunks, 32, ["a"], least_reads=7).count() == 0


def test_types_of_candidates(spark):
    rows = [("1", 10, "a", "5M1I5M", "ACGTATACGTA", False)] * 3 + [("1", 10, "a", "5M1I5M", "ACGTAGACGTA", False)] * 2 + [("1", 10, "b", "5M2D5M", "ACGTAACGTA", False)] * 2 + [("1", 12, "b", "8M", "ACGTACGT", False)] * 2
    got = indels.candidates(indels.spans(reads_frame(spark, rows))).collect()
    assert [(x.chrom, x["at"], x.idv, x.depth) for x in got] == [("1", 14, 5, 9)] and got[0].imf == 1.0
    assert [tuple(t) for t in got[0].types] == [(-2, "", 2), (1, "G", 2), (1, "T", 3)]
    assert np.isfinite(got[0].imf)


def test_points_meet_intervals_in_small_bins(spark):
    """Every pair once, over borders of bins; bins are so small that the join tests few pairs that don't meet."""
    r = random.Random(4)
    left = [(c, p := r.randint(1, 3000), p + r.choice([0, 1, 11, 150, 700]), i) for i, c in enumerate(["1", "2", None] * 100)] + [("1", 255, 256, 900), ("1", 256, 256, 901)]
    right = [(c, r.randint(1, 3800), i) for i, c in enumerate(["1", "2", None] * 60)] + [("1", 256, 900), ("1", 255, 901)]
    got = ranges.point_join(spark.createDataFrame(left, "chrom string, pos long, end long, i int"), spark.createDataFrame(right, "chrom string, at long, k int"))
    plain = sorted((i, k) for c, b, e, i in left for d, at, k in right if c is not None and c == d and b <= at <= e)
    assert sorted((x.i, x.r_k) for x in got.collect()) == plain
    plan = indels.candidates(indels.spans(reads_frame(spark, [("1", 10, "a", "5M1I5M", "ACGTATACGTA", False)])))._jdf.queryExecution().optimizedPlan().toString()
    assert "_probe" not in plan and "level" not in plan


def test_equal_reads_of_a_site_are_compared_once(spark, monkeypatch):
    """A batch compares each distinct pair of read and haplotype once; counts are of all reads."""
    compared = []
    monkeypatch.setattr(indels, "edit_distances", lambda p, t, f=indels.edit_distances: compared.append(len(p)) or f(p, t))
    ran = []
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda self, f, schema: ran.append(f) or self)
    site = {"chrom": "1", "at": 30, "window": "ACGTTGCA" * 10, "left": 1, "types": [{"length": -1, "seq": ""}]}
    reads = [{"chrom": "1", "pos": 11, "sample": "a", "cigar": "40M", "seq": ("ACGTTGCA" * 10)[10:50], "reverse": False} | site] * 50
    empty = spark.createDataFrame([], "chrom string, pos long, end long, sample string, cigar string, seq string, reverse boolean, indels array<int>")
    sites = spark.createDataFrame([], "chrom string, at long, window string, left long, types array<struct<length:int,seq:string>>")
    try:
        indels.realigned(empty, sites)
    except Exception:  # the plan after the caught function isn't needed
        pass
    out = [x for b in ran[-1](iter([pa.RecordBatch.from_pylist(reads)])) for x in b.to_pylist()]
    assert compared == [2] and sum(x["n"] for x in out) == 50 and len(out) == 1 and out[0]["type"] == 0
