import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from siteloom.llm import components, exact_dedup, line_dedup, ngram_join, substring_dedup
from siteloom.llm.common import ASCII_LOWER
from tests.llm.corpus import frame, texts


def low(t):
    return (t or "").encode().translate(ASCII_LOWER)


def test_cuckoo_filter_holds_deletes_and_grows():
    r = random.Random(3)
    keys = [r.getrandbits(64) for _ in range(5000)]
    index = exact_dedup.DigestIndex(16)
    for k in keys:
        index.insert(k, k.to_bytes(8, "big"), 8, 1, 1, 1)
    assert all(index.find(k, k.to_bytes(8, "big"), 8) for k in keys)
    # a hit of the filter is verified: the same key with other content isn't found
    assert index.find(keys[0], b"other", 8) is None
    for k in keys[:2500]:
        assert index.delete(k, k.to_bytes(8, "big"), 8)
    assert not any(index.find(k, k.to_bytes(8, "big"), 8) for k in keys[:2500])
    assert all(index.find(k, k.to_bytes(8, "big"), 8) for k in keys[2500:])
    assert index.live == 2500
    # many contents of one key don't fit a filter's two buckets, and are found all the same
    for i in range(40):
        index.insert(5, bytes([i]), 1, i, i, 1)
    assert all(index.find(5, bytes([i]), 1) for i in range(40))


def test_exact_dedup(spark):
    rows = texts()
    got = exact_dedup.exact_duplicates(frame(spark, rows)).collect()
    groups = defaultdict(list)
    for d, t in rows:
        groups[low(t)].append(d)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(k).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == r.keep_id
    assert kept == Counter(dict.fromkeys(by_sha, 1))


@pytest.mark.parametrize("operator", ["exact", "near", "substring", "lines"])
def test_empty_tables(spark, operator):
    df = frame(spark, [])
    got = {"exact": exact_dedup.exact_duplicates, "near": ngram_join.components_of, "substring": substring_dedup.removals, "lines": line_dedup.line_duplicates}[operator](df)
    assert got.count() == 0


def brute_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = low(t).split()
        n = min(5, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((rows[i][0], len(sets[i]), min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(rows)))


def test_ngram_join(spark):
    rows = texts()
    got = ngram_join.components_of(frame(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_ngram_join_of_many_near_copies_without_their_source(spark):
    """Copies that are alike in pairs only, and a passage that all share."""
    r = random.Random(5)
    passage = [f"p{i}" for i in range(30)]
    rows = []
    for f in range(6):
        words = [f"w{f}x{i}" for i in range(120)]
        for c in range(8):
            w = list(words)
            for at in r.sample(range(120), r.randint(0, 6)):
                w[at] = f"c{f}{c}{at}"
            rows.append((10 * f + c, " ".join(w + passage)))
    got = ngram_join.components_of(frame(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_families_of_half_alike_copies_are_searched_in_blocks(spark, monkeypatch):
    """A source, copies near it, and copies that are alike with few others: small chunks, so that blocks are many."""
    monkeypatch.setattr(ngram_join, "CHUNK", 3)
    r = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    rows = [(0, " ".join(base))]
    for c in range(1, 40):
        w = list(base)
        for at in r.sample(range(100), r.choice([1, 2, 4, 6, 8])):
            w[at] = f"c{c}x{at}"
        rows.append((c, " ".join(w)))
    got = ngram_join.components_of(frame(spark, rows))
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(rows)


def test_divide_skip_against_counting():
    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 12)
        lists = [sorted(r.sample(range(n), r.randint(1, n))) for _ in range(r.randint(1, 15))]
        need = [r.randint(1, 6) for _ in range(n)]
        counts = Counter(m for x in lists for m in x)
        assert ngram_join.divide_skip(lists, need) == {m: c for m, c in counts.items() if c >= need[m]}


def test_bitmap_bound_is_a_bound():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = np.unique(r.integers(0, 400, r.integers(1, 90)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        assert ngram_join.bitmap_bound(ngram_join.bitmap(a), ngram_join.bitmap(b), len(a), len(b)) >= len(np.intersect1d(a, b))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100)}


def test_components_of_randomly_numbered_paths(spark):
    r = random.Random(11)
    ids = [r.getrandbits(63) for _ in range(3400)]
    # a long chain, a ladder, and single links
    edges = [(ids[i], ids[i + 1]) for i in range(2999)] + [(ids[i], ids[i + k]) for i in range(3000, 3298) for k in (1, 2)] + [(ids[i], ids[i + 1]) for i in range(3300, 3400, 2)]
    got = {x.node: x.component for x in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = dict.fromkeys(ids[:3000], min(ids[:3000])) | dict.fromkeys(ids[3000:3300], min(ids[3000:3300]))
    want |= {ids[k]: min(ids[i : i + 2]) for i in range(3300, 3400, 2) for k in (i, i + 1)}
    assert got == want


def test_components_of_few_links_are_written_by_few_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        # many small components, whose labels would be spread over all 40 partitions
        edges = [(i, i + 1) for i in range(0, 800, 2)]
        got = components.connected(spark.createDataFrame(edges, "a long, b long").repartition(4))
        assert len(got.inputFiles()) <= components.TASKS
        assert {x.node: x.component for x in got.collect()} == {i: i - i % 2 for i in range(800)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def brute_removals(rows, width=35):
    docs = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in docs for i in range(len(w) - width + 1))
    out = Counter()
    for (d, _), w in zip(rows, docs, strict=True):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_substring_dedup(spark):
    rows = texts()
    got = substring_dedup.removals(frame(spark, rows), with_text=True).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removals(rows)
    for r in got:
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256
        assert sum(s.after - s.first for s in r.spans) == r.n_removed


def test_substring_dedup_on_a_tiny_alphabet(spark):
    """Few different words: windows repeat inside documents, overlap, and branch."""
    r = random.Random(9)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randint(0, 90)))) for i in range(30)]
    got = substring_dedup.removals(frame(spark, rows), width=9, seed=3).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == brute_removals(rows, 9)


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_within_one():
    r = random.Random(4)
    for _ in range(500):
        a = [r.choice(b"xy") for _ in range(r.randint(0, 6))]
        b = [r.choice(b"xy") for _ in range(r.randint(0, 6))]
        assert line_dedup.within_one(a, b) == (word_distance(a, b) <= 1)


def near(w, e):
    """A word apart if either line has eight words; else a character apart, both of eight characters at least."""
    if max(len(w), len(e)) >= 8:
        return word_distance(w, e) <= 1
    a, b = list(" ".join(w)), list(" ".join(e))
    return min(len(a), len(b)) >= 8 and word_distance(a, b) <= 1


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Accept all cookies\nMenu\nHome"), (2, "Accept all cookie\nMenü\nHome"), (3, "Accept  äll cookies"), (4, "one two three four five six seven"), (5, "one two three four five six seven eight")]
    got = sorted((r.doc_id, r.dropped) for r in line_dedup.line_duplicates(frame(spark, rows)).collect())
    assert got == [(1, []), (2, [0, 2]), (3, [0]), (4, []), (5, [0])]


def test_line_dedup_over_the_border_of_units(spark):
    """Seven words meet eight, whichever comes first; seven words and seven others by characters only."""
    eight = "one two three four five six seven eight"
    seven = [" ".join(w for k, w in enumerate(eight.split()) if k != i) for i in (0, 3, 7)]
    other = "one two three four five six sevens"
    rows = [(1, eight), (2, "\n".join(seven)), (3, other), (4, "one two three four five six SEVEN"), (5, eight.replace("eight", "eighth nine")), (6, eight.replace("two", "2"))]
    got = {r.doc_id: r.dropped for r in line_dedup.line_duplicates(frame(spark, rows)).collect()}
    assert got == {1: [], 2: [0, 1, 2], 3: [0], 4: [], 5: [], 6: [0]}
    back = {r.doc_id: r.dropped for r in line_dedup.line_duplicates(frame(spark, [(1, seven[2]), (2, eight), (3, "one")])).collect()}
    assert back == {1: [], 2: [0], 3: []}


def test_line_dedup(spark):
    r = random.Random(6)
    base = [[f"w{r.randint(0, 30)}" for _ in range(r.randint(2, 14))] for _ in range(25)]
    rows = [(999, None), (998, ""), (997, "\n\n")]
    for i in range(60):
        lines = []
        for _ in range(r.randint(1, 4)):
            w = list(r.choice(base))
            how = r.random()
            if how < 0.3:
                w[r.randrange(len(w))] = f"z{r.randint(0, 5)}"
            elif how < 0.45:
                del w[r.randrange(len(w))]
            elif how < 0.6:
                w.insert(r.randrange(len(w)), f"z{r.randint(0, 5)}")
            lines.append("  ".join(w) if r.random() < 0.2 else " ".join(w))
        rows.append((i, "\n".join(lines)))
    got = {x.doc_id: x for x in line_dedup.line_duplicates(frame(spark, rows)).collect()}
    earlier: list[list[str]] = []
    for d, t in sorted(rows, key=lambda x: x[0]):
        lines = (t or "").split("\n")
        gone = []
        for n, line in enumerate(lines):
            w = line.split()
            if w and any(w == e or near(w, e) for e in earlier):
                gone.append(n)
            if w:
                earlier.append(w)
        assert got[d].n_lines == len(lines)
        assert got[d].dropped == gone, d
    drops = line_dedup.line_duplicates(frame(spark, rows))
    cleaned = {x.doc_id: x.text for x in line_dedup.without_lines(frame(spark, rows), drops).collect()}
    for d, t in rows:
        assert cleaned[d] == (t if not got[d].dropped else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in got[d].dropped))


def test_line_dedup_of_repeated_rows(spark):
    line = "a b c d e f g h i j"
    got = sorted((r.doc_id, r.dropped) for r in line_dedup.line_duplicates(frame(spark, [(1, line), (1, line), (2, line + " k")])).collect())
    assert got == [(1, []), (1, [0]), (2, [0])]


def test_paths_end_at_branches(spark):
    """a-b-c always follow each other, d follows c or stands alone, e and f name each other on one side only."""
    schema = "piece long, n int, times long, before long, after long, one struct<rid:long,at:int>"
    rows = [(1, 3, 2, 0, 2, (0, 0)), (2, 4, 2, 1, 3, (0, 3)), (3, 5, 2, 2, None, (0, 7)), (4, 6, 4, None, 0, (0, 12)), (5, 2, 3, 9, 6, (1, 0)), (6, 2, 4, None, 0, (1, 2))]
    got = substring_dedup.compacted(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.piece, r.n, r.windows) for r in got) == [(1, 3, 12), (4, 6, 6), (5, 2, 2), (6, 2, 2)]


def test_spans_are_verified_at_their_coordinates():
    words = [b"w%d" % i for i in range(60)]
    path = {"at": 5, "n": 10, "mask": None, "digest": substring_dedup.digest_of(words[5:49])}
    assert substring_dedup.spans_of([path], words, 35) == [(5, 49)]
    assert substring_dedup.spans_of([path], [*words[:20], b"other", *words[21:]], 35) == []
