"""Running values with any number of ranges."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siteloom.operators import carried as ca
from siteloom.operators import hmm, select, sequence, summaries, windows
from tests.test_variants import frame, site


@pytest.fixture(params=["1", "2", "9", "40"])
def ranges(spark, request):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_carried_equals_one_window(spark, ranges):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", "c", None]), i, r.choice([None, *range(-5, 9)])) for i in range(200)] + [("alone", 1, 7), ("null", 2, None)]
    df = spark.createDataFrame(rows, "k string, o int, v int").repartition(3)
    w = Window.partitionBy("k").orderBy("o")
    for inclusive in (True, False):
        f = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        want = df.withColumns({"s": F.coalesce(F.sum("v").over(f), F.lit(0)), "m": F.max("v").over(f), "b": F.lag("v").over(w), "a": F.lead("v").over(w)})
        got = ca.carried(ca.ranged(df, ["k"], ["o"]), ["k"], ["o"], {"s": F.col("v")}, {"m": F.col("v")}, {"b": F.col("v")}, {"a": F.col("v")}, inclusive)
        assert sorted(map(str, got.drop(ca.RANGE).select(want.columns).collect())) == sorted(map(str, want.collect()))
    empty = ca.carried(ca.ranged(df.where("false"), ["k"], ["o"]), ["k"], ["o"], {"s": F.col("v")})
    assert empty.count() == 0


def random_sites(seed, n=120):
    r = random.Random(seed)
    out, pos = [], 1
    for i in range(n):
        pos += r.choice([1, 1, 2, 3, 15])
        ref = "A" * r.choice([1, 1, 2, 6])
        alt = r.choice(["C", ref + "G", "A"]) if len(ref) > 1 else r.choice(["C", "AG"])
        out.append(site(pos, ref=ref, alts=(alt,), qual=float(r.randint(1, 99)), samples=((r.choice(["0/0", "0/1", "./.", "1"]), r.choice([5, 25]), None), ("0/0", 9, None)), chrom=r.choice("12") if i % 7 else "1"))
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_operators_do_not_depend_on_ranges(spark, ranges):
    """Each operator against a walk over the sites."""
    rows = random_sites(3)
    df = frame(spark, rows)
    ends = lambda x: x[2] + len(x[5]) - 1
    by = {c: [x for x in rows if x[0] == c] for c in "12"}
    over = {(c, x[2]) for c, xs in by.items() for x in xs if any(y is not x and y[2] <= ends(x) and ends(y) >= x[2] for y in xs)}
    assert {(x.chrom, x.pos) for x in windows.overlaps(df).where("overlap").collect()} == over
    counts = {(c, x[2]): max(sum(1 for y in xs if z[2] <= y[2] < z[2] + 20) for z in xs if z[2] <= x[2] < z[2] + 20) for c, xs in by.items() for x in xs}
    assert {(x.chrom, x.pos): x.n_in_window for x in windows.window_counts(df, 20, block=50).collect()} == counts
    means = {(c, x[2]): sum(y[7] for y in xs[max(0, i - 2) : i + 3]) / len(xs[max(0, i - 2) : i + 3]) for c, xs in by.items() for i, x in enumerate(xs)}
    assert {(x.chrom, x.pos): x.mean for x in windows.moving_average(df, "qual", 5, block=12).collect()} == pytest.approx(means)
    is_indel = lambda x: len(x[5]) != len(x[6][0]) and x[5][0] == x[6][0][0]
    best = set()
    for c, xs in by.items():
        indels = [x for x in xs if is_indel(x)]
        chain, reach = [], None
        for x in [*indels, None]:
            if x is None or reach is not None and x[2] - reach > 4:
                if chain:
                    best.add((c, max(chain, key=lambda y: (y[7], sum(1 for s in y[10] for a in s[0][0] if a), -y[2]))[2]))
                chain, reach = [], None
            if x is not None:
                chain.append(x)
                reach = max(reach or 0, ends(x))
    kept = {(x.chrom, x.pos) for x in select.indel_gap(df, 4).where("not array_contains(filters, 'IndelGap')").collect()}
    assert {(c, p) for c, p in kept if any(x[0] == c and x[2] == p and is_indel(x) for x in rows)} == best
    runs = summaries.ploidy_runs(df).where("sample = 0").collect()
    called = {c: [(x[2], len(x[10][0][0][0])) for x in xs if None not in x[10][0][0][0]] for c, xs in by.items()}
    assert sum(1 for c in "12" for i, (p, k) in enumerate(called[c]) if i == 0 or called[c][i - 1][1] != k) == len(runs)
    chunks = spark.createDataFrame([(c, 0, "A" * 1000) for c in "12"], "chrom string, chunk long, seq string")
    for x in sequence.consensus(df, chunks, 1000).collect():
        text, reach = list("A" * 1000), 0
        for y in by[x.chrom]:
            if y[2] > reach:
                text[y[2] - 1 : ends(y)] = [y[6][0], *[""] * (len(y[5]) - 1)]
            reach = max(reach, ends(y))
        assert x.seq == "".join(text)


def test_training_does_not_depend_on_the_cut(spark):
    """Expected transitions summed over pieces against one array, and two chains at once."""
    import numpy as np

    from siteloom.operators import hmm

    r = np.random.default_rng(6)
    start = np.array([[0.9, 0.1], [0.2, 0.8]])
    chains = {}
    for chrom in "12":
        state, seen = 0, []
        for _ in range(60):
            state = state if r.random() < 0.93 else 1 - state
            seen.append(int(r.random() < (0.85 if state else 0.2)))
        chains[chrom] = seen
    shows = lambda x: np.stack([np.where(x, 0.2, 0.8), np.where(x, 0.85, 0.15)], 1)
    frame_ = lambda names: spark.createDataFrame([(0, c, 5 * i, x) for c in names for i, x in enumerate(chains[c])], "sample int, chrom string, pos long, x int")
    emissions = lambda p: shows(p["x"].to_numpy() > 0)
    want = hmm.trained_transitions(shows(np.array(chains["1"]) > 0), start, rounds=3, tolerance=0)
    for piece in (7, 1000):
        assert hmm.trained(frame_("1"), emissions, start, rounds=3, tolerance=0, piece=piece) == pytest.approx(want, abs=1e-9)
    both = [hmm.trained(frame_("12"), emissions, start, rounds=2, tolerance=0, piece=piece) for piece in (9, 100)]
    assert both[0] == pytest.approx(both[1], abs=1e-9) and abs(both[0].sum(1) - 1).max() < 1e-9


def test_pairs_by_some_allele(spark):
    """Sites of one position that share an ALT, whatever their REFs; chains of such pairs; intersections, complements and merging."""
    from siteloom.operators import merge, setops

    a = frame(spark, [site(1, ref="A", alts=("C", "G")), site(2, ref="A", alts=("C",)), site(3, ref="A", alts=("<DEL>",)), site(4, ref="A", alts=())])
    b = frame(spark, [site(1, ref="AT", alts=("GT", "TT")), site(2, ref="A", alts=("G",)), site(3, ref="A", alts=("<DEL>", "T")), site(4, ref="A", alts=())])
    c = frame(spark, [site(1, ref="A", alts=("T",))])
    both = lambda tables, pattern: sorted(x.pos for x in setops.intersect(tables, pattern, logic="some").collect())
    assert both([a, b], "=2") == [1, 3, 4] and both([a, c], "=2") == [] and both([a, b, c], "=3") == [1]
    assert [x.pos for x in setops.complement([a, b], "some").collect()] == [2]
    assert {k: sorted(x.pos for x in v.collect()) for k, v in setops.venn(a, b, "some").items()} == {"only_a": [2], "only_b": [2], "shared_a": [1, 3, 4], "shared_b": [1, 3, 4]}
    merged = {(x.pos, x.ref, tuple(x.alts)) for x in merge.merge_all([a, b], [2, 2], "some").collect()}
    assert {m[0] for m in merged if sum(n[0] == m[0] for n in merged) == 1} == {1, 3, 4} and sum(m[0] == 2 for m in merged) == 2


def test_best_non_overlapping_equals_row_by_row(spark):
    """Rows of one base to whole contigs, equal ones, ties of QUAL and none, over borders of blocks; the plain version goes row by row."""
    r = np.random.default_rng(11)
    rows = []
    for chrom in ("1", "2", None):
        for _ in range(150):
            size = int(10 ** r.uniform(0, 2.5)) if r.random() < 0.3 else int(r.integers(1, 4))
            rows.append((chrom, int(r.integers(1, 900)), "A" * size, ["C", "G"][: int(r.integers(1, 3))], None if r.random() < 0.1 else float(r.integers(0, 40))))
    rows += [*rows[:5], ("3", 1, "A" * 1000, ["C"], 5.0), *[("3", k, "A", ["C"], 4.0) for k in range(3, 900, 50)], ("4", 1, "A" * 1000, ["C"], 5.0), ("4", 500, "A", ["C"], 6.0), ("5", 1, None, ["C"], 1.0), ("5", None, "A", ["C"], 1.0)]
    df = spark.createDataFrame(rows, "chrom string, pos long, ref string, alts array<string>, qual double")

    left, out = [], []
    for x in sorted((x for x in rows if x[1] is not None and x[2] is not None), key=lambda x: (x[4] or 0, x[1], x[2], ",".join(x[3]))):
        left.append(x)
    alive = [True] * len(left)
    for i, x in enumerate(left):
        alive[i] = not any(alive[j] and j != i and y[0] == x[0] and y[1] < x[1] + len(x[2]) and x[1] < y[1] + len(y[2]) for j, y in enumerate(left))
        out.append((str(x[0]), x[1], x[2], ",".join(x[3]), not alive[i]))
    out += [("5", 1, "None", "C", False), ("5", "None", "A", "C", False)]
    for block in (7, 64, 1 << 17):
        got = [(str(x.chrom), x.pos if x.pos is not None else "None", str(x.ref), x.alt, x.removed) for x in windows.best_non_overlapping(df.repartition(5), block).collect()]
        assert sorted(map(str, got)) == sorted(map(str, out))
    plan = windows.best_non_overlapping(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan  # no chain of overlapping rows is looked for, which may be a whole contig


def plain_pieces(e, t, before, end, ahead, back):
    """Site after site: total log weights of the paths, the best path between two states, posteriors."""
    n, k = e.shape
    total, scale = t[0] * e[0], 0.0
    for i in range(1, n):
        total = (total @ t[i]) * e[i]
        scale, total = scale + np.log(total.max()), total / total.max()
    v, came = np.log(t[0][before] if before >= 0 else t[0].max(0)) + np.log(e[0]), []
    for i in range(1, n):
        step = v[:, None] + np.log(t[i])
        came.append(step.argmax(0))
        v = step.max(0) + np.log(e[i])
    path = [end]
    for c in came[::-1]:
        path.append(int(c[path[-1]]))
    a, b = np.empty((n, k)), np.empty((n, k))
    now = np.exp(ahead)
    for i in range(n):
        now = (now @ t[i]) * e[i]
        now = a[i] = now / now.sum()
    now = b[-1] = np.exp(back)
    for i in range(n - 2, -1, -1):
        now = t[i + 1] @ (e[i + 1] * now)
        now = b[i] = now / now.sum()
    return np.log(total) + scale, path[::-1], a * b / (a * b).sum(1, keepdims=True)


@pytest.mark.parametrize("states", [2, 4])
def test_segments_of_a_piece_are_solved_side_by_side(states):
    """Any number of sites gives what going from site to site gives, in a fraction of its time."""
    r = np.random.default_rng(states)
    for n in (1, 2, 3, 8, 9, 10, 143, 20_000):
        e, t = r.random((n, states)) + 0.01, r.random((n, states, states)) ** 4 + 1e-9
        t /= t.sum(2, keepdims=True)
        ahead, back = np.log(r.random(states)), np.log(r.random(states))
        for before, end in ((-1, 0), (1, 1)):
            begun = time.process_time()
            total, path, posterior = plain_pieces(e, t, before, end, ahead, back)
            plain, begun = time.process_time() - begun, time.process_time()
            got = hmm.transfer(e, t)[1], hmm.between(e, t, before, end), hmm.posteriors(e, t, ahead, back)
            took = time.process_time() - begun
            assert np.allclose(got[0], total, rtol=1e-9, atol=1e-9) and got[1].tolist() == path and np.allclose(got[2], posterior)
        assert n < 20_000 or took < plain / 2
