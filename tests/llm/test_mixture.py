"""Fill-in-the-middle, mixing and divergence against plain versions, with nulls, ties, copies and empty tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from siteloom.llm import divergence, fill_middle, mixing
from tests.llm.corpus import SCHEMA, frame, texts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle
ODD = [(900, "<P>"), (901, "a<S"), (902, "x" * 200_000), (903, "\n\r\t \x00"), (904, "héé 漢字😀 a1b2"), (905, "<S" * 5), (906, "A"), (907, "-"), (None, "null id"), (908, "a" + " b" * 50_000)]


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert "".join(units) == text
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, text)
    if h4 % 100 < 20:
        return (doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_middle_equals_a_plain_version_and_restores(spark):
    rows = texts() + ODD
    got = fill_middle.filled(frame(spark, rows)).collect()
    want = Counter((*plain_fim(d, t), sha(plain_fim(d, t)[-1]), sha(t or "")) for d, t in rows)
    assert Counter(tuple(r) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(fill_middle.restored(r.output, r.form) == (dict(rows)[r.doc_id] or "") for r in got if r.doc_id is not None)
    short = fill_middle.filled(frame(spark, rows), texts=False)
    assert "output" not in short.columns and dict(short.dtypes)["prefix_chars"] == "bigint"
    assert fill_middle.filled(frame(spark, [])).count() == 0


def test_seed_decides_the_cuts(spark):
    docs = frame(spark, texts())
    one, again, two = (sorted(map(str, fill_middle.filled(docs, seed).collect())) for seed in (5, 5, 6))
    assert one == again != two


# --- mixing
def plain_targets(sizes):
    """By resharing in rounds, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, budget = set(), Fraction(3, 2) * sum(sizes.values())
    while True:
        open_ = [s for s in order if s not in full]
        left = budget - sum(2 * sizes[s] for s in full)
        target = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target | {s: Fraction(2 * sizes[s]) for s in full}
        full |= over


def mixed_rows(n=600, seed=3):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.randint(0, 60))), None, r.choice(["a", "b", "É", "z", "", None, "only"] if i % 3 else ["hot"]), 1, 2, "k", 0.5, 3) for i in range(n)]
    rows += [(None, None, None, "a", 1, 2, "k", 0.5, 3), (7, "", None, "nothing", 1, 2, "k", 0.5, 3), (8, "one", None, "single", 1, 2, "k", 0.5, 3)]
    return rows + [(5, "the same row again", None, "hot", 1, 2, "k", 0.5, 3)] * 300


def test_mixing_reaches_its_targets(spark):
    rows = mixed_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mixed(docs.repartition(5)).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((x[0], x[3], len((x[1] or "").split())) for x in rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
    want = plain_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(float(want[r.source]))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= Fraction(largest[s], 2) + Fraction(1, 1000)
    assert any(want[s] == 2 * sizes[s] > 0 for s in sizes) and any(0 < want[s] < 2 * sizes[s] for s in sizes)
    again = mixing.mixed(docs.repartition(2)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert mixing.mixed(frame(spark, [])).count() == 0


def test_mixing_takes_the_least_odds(spark):
    """Within a source the taken documents are the first by random odds over inclusion odds, ordered in one list."""
    rows = [(i, "w " * (1 + i % 5), None, "a" if i % 4 else "b", 1, 2, "k", 0.5 + i % 7, 3) for i in range(800)]
    got = {r.doc_id: r for r in mixing.mixed(spark.createDataFrame(rows, SCHEMA), preference="score").collect()}
    for source in "ab":
        some = next(r for r in got.values() if r.source == source)
        whole = int(some.target // some.source_size)
        p = some.target / some.source_size - whole

        def odds(x, p=p):
            u = (int(hashlib.md5(f"1:{x[0]}:{x[1]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return u / (1 - u) / (p / (1 - p) * x[7])

        taken = 0
        for x in sorted((x for x in rows if x[3] == source), key=odds) if p > 1e-9 else []:
            extra = taken + got[x[0]].size / 2 <= some.target - whole * some.source_size
            assert got[x[0]].copies == whole + extra
            taken += got[x[0]].size


def test_inclusion_follows_its_odds(spark):
    """Over many seeds documents of equal size are taken as often as their source asks for."""
    rows = [(i, "a b c", None, "x" if i % 2 else "y", 1, 2, "k", 0.5, 3) for i in range(40)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).cache()
    often = Counter()
    for seed in range(8):
        often.update({(r.source, r.doc_id): r.copies for r in mixing.mixed(docs, weights=(3, 1), share=0.5, seed=seed).collect()})
    for source, share in (("x", 0.75), ("y", 0.25)):
        mine = [v for (s, _), v in often.items() if s == source]
        assert sum(mine) == 8 * 20 * share
        assert len(set(mine)) > 3  # chance, not an order of ids


# --- divergence
def plain_divergence(rows, least=3, top=200):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", text or ""
        groups[lang].add(source)
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        n[lang, source].update(terms)
        n[lang, None].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]

        def share(source, lang=lang, kept=kept):
            total = sum(n[lang, source][t] for t in kept)
            return {t: 1 + 10**9 * (n[lang, source][t] + 1) // (total + len(kept)) for t in kept}

        p, q = {s: share(s) for s in sources}, share(None)
        for s in sources:
            pairs = [(-sum((p[s][t] - p[h][t]) ** 2 // p[h][t] for t in kept), h.encode()) for h in sources - {s}]
            best = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return out


def divergence_rows(seed=2, n=300):
    r = random.Random(seed)
    words = ["The", "the", "É", "é", "word", "wörd", "x1y", "a-b", "漢字", "snake_case", "😀", "O'Neil"]
    rows = [(r.choice(["en", "fr", None, ""]), r.choice(["s1", "s2", "É", "", None, "s%d" % r.randint(3, 9)]), " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in range(n)]
    return rows + [("xx", "alone", "a b c"), ("yy", "one", "once only"), ("yy", "two", None), ("yy", "three", ""), (None, None, None)] + [("en", "hot", "copy " * 30)] * 150


@pytest.mark.parametrize("tile", [divergence.TILE, 20])
def test_divergence_equals_a_plain_version(spark, tile):
    rows = divergence_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({"term": F.lit("x"), "n": F.lit(1), "doc_id": F.lit(None)})
    got = divergence.divergence(df.repartition(4), tile=tile, top=5).collect()
    assert Counter(map(tuple, got)) == Counter(plain_divergence(rows, top=5))


def test_divergence_of_an_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_shares_are_exact_for_large_counts():
    r = random.Random(1)
    for _ in range(300):
        total = r.randint(1, 9 * 10**15)
        count = r.randint(0, total - 1)
        assert int(divergence.shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * (count + 1) // total


def test_pair_sums_by_pieces(monkeypatch):
    p = np.random.default_rng(1).integers(1, 10**9, (7, 23))
    want = [[sum((int(a) - int(b)) ** 2 // int(b) for a, b in zip(p[g], p[h], strict=True)) for h in range(7)] for g in range(7)]
    for cells in (1, 10, 50, 10**6):
        monkeypatch.setattr(divergence, "BROADCAST_CELLS", cells)
        assert divergence.pair_sums(p, 0, 7).tolist() == want and divergence.pair_sums(p, 2, 5).tolist() == want[2:5]


def test_counter_gives_out_what_it_holds(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "GATHERED", 3)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["a", "b", "a", "a"], "text": ["x y z", "x", "p q r s", "x x"]})
    total = Counter()
    for b in divergence._counter(iter([batch])):
        for r in b.to_pylist():
            total[r["source"], r["term"]] += r["n"]
    assert total["a", "x"] == 3 and total["b", "x"] == 1 and total["a", "s"] == 1
