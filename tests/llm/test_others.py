import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from siteloom.llm import decontamination, license_scan, packing, quality_crf, sharding, toxicity_gru
from siteloom.llm.license_texts import KNOWN
from tests.llm.corpus import frame, texts, words


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    from siteloom.llm.common import tokenizer_path

    return Tokenizer.from_file(tokenizer_path())


def test_tokenizer_equals_the_library(library):
    odd = ["I'm <|endoftext|> don't É ß ǅ Σας İx ①½ \x1c a\x85b é ́x 'sad rock'n'roll ''s 'S z y 漢字 ok", "", "''' 'tis", "don't've 'll", "x_1 3.14 a\tb\r\nc", *[t or "" for _, t in texts()]]
    fast = packing.WordTokenizer()
    assert [np.frombuffer(x, "<u4").tolist() for x in fast.encode(odd)] == [e.ids for e in library.encode_batch(odd, add_special_tokens=False)]


def test_packing(spark, library):
    rows = texts()
    capacity = 128
    got = packing.packed(frame(spark, rows), capacity).collect()
    want = Counter()
    for d, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], "<u4")
            want[(d, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in got)
    assert len(places) <= 1.15 * -(-total // capacity) + 2
    assert packing.packed(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_are_gapless_and_near_the_bound(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(2048, np.maximum(1, r.lognormal(*[(6, 1), (5, 0.5), (6.5, 0.3)][seed % 3], 3000).astype(int)))
    h = dict(zip(*[x.tolist() for x in np.unique(lengths, return_counts=True)], strict=True))
    plan = packing.planned(h)
    places = defaultdict(list)
    for n, takes in plan.takes.items():
        assert sum(t[1] for t in takes) == h[n]
        rank = 0
        for first, count, sequence, each, offset in takes:
            assert first == rank
            rank += count
            for k in range(count):
                places[sequence + k // each].append((offset + k % each * n, n))
    for parts in places.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    assert plan.sequences == len(places)
    bound = -(-int(lengths.sum()) // 2048)
    assert plan.sequences <= 1.12 * bound


def test_configurations_reach_a_known_optimum():
    # 30 of 1000 and 30 of 1040: no pair of the larger fits with another, but one of each does
    found = packing.configurations([1040, 1000], [30, 30], 2048)
    assert sum(a for _, a in found) == pytest.approx(30)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 65537])
def test_feistel_is_a_bijection(n):
    p = sharding.permuted(np.arange(n), n)
    assert sorted(p.tolist()) == list(range(n))
    assert (sharding.permuted(p, n, inverse=True) == np.arange(n)).all()
    shard, slot = sharding.locate(n - 1, n, 16)
    assert sharding.row_at(shard, slot, n, 16) == n - 1


def test_sharding(spark):
    rows = texts()
    got = sharding.sharded(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    for r in got:
        assert (r.shard, r.slot) == sharding.locate(r.row_number, len(rows), 16)
    again = sharding.sharded(frame(spark, rows[::-1])).collect()
    unique = [d for d, c in Counter(d for d, _ in rows).items() if c == 1]
    place = {r.doc_id: (r.shard, r.slot) for r in got}
    assert all(place[r.doc_id] == (r.shard, r.slot) for r in again if r.doc_id in unique)
    assert sharding.sharded(frame(spark, [])).count() == 0


def brute_containment(rows, items):
    out = Counter()
    for d, t in rows:
        w = decontamination.words_of(t)
        for i, s in items:
            v = decontamination.words_of(s)
            n = min(5, len(v))
            if not n:
                continue
            have = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
            want = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            if len(want & have) >= 0.75 * len(want):
                out[(d, i, len(want), len(want & have))] += 1
    return out


def test_decontamination(spark):
    r = random.Random(8)
    rows = texts()
    body = [w for _, t in rows[:30:3] for w in (t or "").split()]
    items = [(i, " ".join(body[at : at + n])) for i, (at, n) in enumerate([(0, 30), (50, 60), (120, 8), (200, 4), (300, 1), (400, 90)])]
    edited = items[1][1].split()
    edited[30] = "edited"
    items += [(10, " ".join(edited).upper()), (11, " ".join(words(r, 40))), (12, None), (13, " "), (0, items[0][1])]
    df = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contaminations(frame(spark, rows), df)
    want = brute_containment(rows, items)
    assert Counter((x.doc_id, x.item_id, x.n_shingles, x.n_found) for x in got.collect()) == want
    dirty = {d for d, *_ in want}
    kept = decontamination.clean(frame(spark, rows), df)
    assert kept.columns == frame(spark, rows).columns
    assert Counter(x.doc_id for x in kept.collect()) == Counter(d for d, t in rows if not any(k[0] == d for k in brute_containment([(d, t)], items)))
    assert dirty
    # small blocks give the same as one
    parts = [decontamination.matched(frame(spark, rows, extra=False), b).select("doc_id", "matches").collect() for b in decontamination.blocks(df, limit=50)]
    assert sum(len(m.matches) for p in parts for m in p) == sum(want.values())
    assert decontamination.contaminations(frame(spark, []), df).count() == 0
    assert decontamination.contaminations(frame(spark, rows), df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 5, 16, 17, 40, 200])
def test_signatures_miss_less_than_promised(size):
    from math import comb

    values, need = decontamination.signature_size(size)
    assert 1 <= need <= values <= max(size, 32)
    if size > 16:
        assert sum(comb(values, j) * 0.75**j * 0.25 ** (values - j) for j in range(need)) < decontamination.MISS


def test_licenses(spark):
    mit = next(t for i, t in KNOWN if i == "MIT")
    rows = [(1, mit), (2, "Copyright (c) 2020 Some One\n\n" + mit.replace('"', "''").upper()), (3, mit.replace(" ", "\n", 40).replace("holders", "owners")), (4, mit + " or not"), (5, None), (6, ""), (7, "Some text"), (1, mit), (None, mit)]
    got = sorted(((r.doc_id or 0, r.license_id or "") for r in license_scan.scanned(frame(spark, rows), license_scan.known_licenses(spark)).collect()))
    assert got == [(0, "MIT"), (1, "MIT"), (1, "MIT"), (2, "MIT"), (3, "MIT"), (4, ""), (5, ""), (6, ""), (7, "")]
    assert license_scan.scanned(frame(spark, []), license_scan.known_licenses(spark)).count() == 0


def test_license_scan_equals_its_sql_on_licences(spark):
    """Every known licence, as it is and rewritten, and texts that only contain one, by the operator and by SQL."""
    import duckdb

    from siteloom.llm.license_texts import whole_texts

    rows = []
    for k, (_, t) in enumerate(whole_texts()):
        rewritten = "Copyright (c) 2020 Someone\n\n" + t.upper().replace(" ", "  ").replace("LICENSE", "LICENCE")
        rows += [(10 * k, t), (10 * k + 1, rewritten), (10 * k + 2, t + "\nand more"), (10 * k + 3, t.replace("\n", "\r\n"))]
    rows += [(-1, None), (-2, ""), (None, "no licence")]
    got = license_scan.scanned(frame(spark, rows), license_scan.known_licenses(spark)).toPandas()
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).select("doc_id", "text").toPandas().astype({"doc_id": "Int64"}))
    want = con.execute(license_scan.OP9_SQL).fetchall()
    mine = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.text_digest, r.license_id or None) for r in got.itertuples()]
    assert Counter(map(str, mine)) == Counter(map(str, want))
    known = {d for d, _, i in want if i}
    assert {10 * k for k in range(len(whole_texts()))} | {10 * k + 1 for k in range(len(whole_texts()))} | {10 * k + 3 for k in range(len(whole_texts()))} == known


def test_long_licenses(spark):
    folder = Path(license_scan.__file__).parent / "licenses"
    whole = {p.stem: p.read_text() for p in folder.glob("*.txt")}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "BSL-1.0"} <= set(whole)
    ids = sorted(whole)
    apache = whole["Apache-2.0"]
    rows = [(i, " ".join(whole[x].upper().split(" "))) for i, x in enumerate(ids)] + [(100, apache[: apache.index("APPENDIX")]), (101, apache.replace("irrevocable", "revocable")), (102, "Licensed under CC BY-NC 4.0.")]
    got = {r.doc_id: r.license_id for r in license_scan.scanned(frame(spark, rows), license_scan.known_licenses(spark)).collect()}
    assert got == dict(enumerate(ids)) | {100: "Apache-2.0", 101: None, 102: None}


def test_sample_is_filled_from_documents_that_are_there(spark):
    from siteloom.llm import labelled

    # most labelled documents are long, and most labels have no document
    docs = frame(spark, [(i, "short text" if i % 10 == 0 else "long " * 100) for i in range(200)])
    labels = spark.createDataFrame([(i, i // 10 % 2) for i in range(2000)], "doc_id long, toxic int")
    got, ys = labelled.sample(docs, labels, "toxic", 5, 0, {0: 5, 1: 100}, 50)
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert all(t == "short text" or (len(t) == 50 and t in "long " * 100) for t in got)
    assert Counter(ys) == {y: min(n, sum(i // 10 % 2 == y for i in ids)) for y, n in {0: 5, 1: 100}.items()}


def test_sample_of_texts_whose_bytes_times_the_bound_pass_32_bits(spark):
    from siteloom.llm import labelled

    # one letter of one byte and one of two, so a part of 20000 bytes is 13333 characters
    body = "é " * 150_000
    docs = frame(spark, [(i, body if i % 2 else "word " * 50_000) for i in range(12)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    got, ys = labelled.sample(docs, labels, "quality", 4, 2, {0: 9, 1: 9}, 20_000)
    assert Counter(ys) == Counter(i % 2 for i in range(12) if zlib.crc32(str(i).encode()) % 4 != 2)
    assert all((len(t) == 13_333 and t in body) if y else (len(t) == 20_000 and t in "word " * 50_000) for t, y in zip(got, ys, strict=True))


def lines_of(r, good):
    line = " ".join(words(r, r.randint(6, 20)))
    return line[0].upper() + line[1:] + "." if good else line.upper().replace(" ", "!! ") + "!!"


def labelled(n=160, seed=3):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        q, t = int(i % 4 != 0), int(i % 5 == 0)
        body = [lines_of(r, q) for _ in range(r.randint(2, 8))]
        if t:
            body[r.randrange(len(body))] += " what an odious blockhead you are"
        docs.append((i, "\n".join(body)))
        labels.append((i, q, t))
    return docs, labels


def test_forward_backward_against_enumeration():
    import itertools

    field = quality_crf.LineField(1)
    field.w, field.t = np.array([1.3, -0.4, 0.2]), np.array([[0.7, -0.2], [0.1, 0.5]])
    r = np.random.default_rng(0)
    lengths = [1, 4, 6]
    first = np.concatenate([[0], np.cumsum(lengths)])
    x = r.normal(size=(first[-1], 3))
    p, pairs = field.marginals(x, first, pairs=True)
    expected = np.zeros((2, 2))
    for a, b in zip(first[:-1], first[1:], strict=True):
        z, m, e = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for path in itertools.product((0, 1), repeat=b - a):
            s = np.exp(sum(x[a + i] @ field.w * y for i, y in enumerate(path)) + sum(field.t[path[i], path[i + 1]] for i in range(b - a - 1)))
            z += s
            m += s * np.array(path)
            for i in range(b - a - 1):
                e[path[i], path[i + 1]] += s
        assert np.allclose(p[a:b], m / z)
        expected += e / z
    assert np.allclose(pairs, expected)


def test_quality(spark):
    docs, labels = labelled()
    edge = [(1000, None), (1001, ""), (None, "Some plain words here."), (3, docs[3][1])]
    lab = spark.createDataFrame([*labels, (2000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, docs + edge)
    out = {r.doc_id: r.score for r in quality_crf.scored(df.select("doc_id", "text"), quality_crf.fit(df, lab)).collect()}
    held = [(i, q) for i, q, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(out[i] >= quality_crf.CUT) == q for i, q in held]) > 0.95
    assert out[1000] == out[1001] == 0
    kept = quality_crf.good(df, lab)
    assert kept.columns == df.columns and set(r.doc_id for r in kept.collect()) >= {i for i, q, _ in labels if q and out[i] >= quality_crf.CUT}
    # without labels nothing but empty texts goes
    assert quality_crf.good(df, lab.limit(0)).count() == len(docs) + 2
    assert quality_crf.scored(frame(spark, [], extra=False), quality_crf.LineField(quality_crf.N_FEATURES)).count() == 0


def test_lines_of_a_mixed_document_get_mixed_labels():
    """Labels are of documents; a third of the bad ones hold good lines as well, in one block."""
    r = random.Random(8)
    docs, labels, truth = [], [], []
    for i in range(240):
        good = i % 2
        lines = [good] * r.randint(4, 9)
        if not good and i % 3 == 0:
            lines[: len(lines) // 2] = [1] * (len(lines) // 2)
        docs.append("\n".join(lines_of(r, q) for q in lines))
        labels.append(good)
        truth.append(lines)
    field = quality_crf.fitted(docs[:200], labels[:200])
    x, _, first = quality_crf.line_features([d.encode() for d in docs[200:]])
    p, _ = field.marginals(quality_crf.with_neighbours(x, first), first)
    mixed = [(p[first[k] + j] > 0.5) == q for k, lines in enumerate(truth[200:]) if len(set(lines)) == 2 for j, q in enumerate(lines)]
    assert len(mixed) > 20 and np.mean(mixed) > 0.8  # a line beside the change counts half


def test_quality_score_against_a_plain_version():
    """Features of one line, and the document score from enumerated label paths, written out once more."""
    import itertools

    text = "A Plain line, with 12 words or so and words again and again.\n\nSHOUT!! SHOUT!! | é"
    x, size, first = quality_crf.line_features([text.encode()])
    for k, line in enumerate(text.encode().split(b"\n")):
        n, ws = max(1, len(line)), line.split()
        shares = [sum(c in chars for c in line) / n for chars in quality_crf.CLASSES.values()]
        again = sum(u == v for u, v in zip(ws[:-1], ws[1:], strict=True)) / max(1, len(ws))
        rest = [again, len(set(ws)) / max(1, len(ws)), min(1, 20 * (shares[5] > 0)), 0, np.log1p(min(len(line), 2000)) / 8, min(len(line) / max(1, len(ws)), 30) / 10, np.log1p(min(len(ws), 300)) / 6, not line, 1]
        assert np.allclose(x[k], [*shares, *rest])
    field = quality_crf.LineField(quality_crf.N_FEATURES)
    rng = np.random.default_rng(1)
    field.w, field.t, field.a, field.b = rng.normal(size=len(field.w)), np.array([[0.4, -0.1], [0.2, 0.3]]), 3.0, -1.0
    near = [np.concatenate([x[k], x[k - 1] if k else 0 * x[0], x[k + 1] if k < 2 else 0 * x[0]]) for k in range(3)]
    weight, z, good = size, 0.0, np.zeros(3)
    for path in itertools.product((0, 1), repeat=3):
        s = np.exp(sum(near[k] @ field.w * y for k, y in enumerate(path)) + sum(field.t[path[k], path[k + 1]] for k in range(2)))
        z, good = z + s, good + s * np.array(path)
    q = (good / z * weight).sum() / weight.sum()
    assert field.score([text.encode(), b""]) == pytest.approx([1 / (1 + np.exp(-(3 * q - 1))), 0.0])


def test_gradients_against_differences():
    model = toxicity_gru.ToxicityModel(1)
    r = np.random.default_rng(2)
    x = r.normal(size=(5, 4, toxicity_gru.N_INPUTS))
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    mask = np.arange(5)[:, None] < np.array([5, 3, 1, 4])
    y, w = np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        p, _ = model.forward(x @ model.p["Wf"] + model.p["cf"], x @ model.p["Wb"] + model.p["cb"], mask)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum()

    g = model.gradients(x, y, w, mask)
    for k, v in model.p.items():
        for at in list(np.ndindex(v.shape))[:: max(1, v.size // 5)]:
            old = v[at]
            v[at] = old + 1e-3
            up = loss()
            v[at] = old - 1e-3
            down = loss()
            v[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-3, abs=2e-4), k


def test_windows_cover_every_word_and_overlap():
    starts = np.array([0, 0, 5, 37, 37 + 500])
    first, size, text = toxicity_gru.windows_of(starts)
    for t in range(4):
        covered = Counter(i for f, n in zip(first[text == t], size[text == t], strict=True) for i in range(f, f + n))
        assert set(covered) == set(range(starts[t], starts[t + 1]))
    inner = Counter(i for f, n in zip(first[text == 3], size[text == 3], strict=True) for i in range(f, f + n))
    assert min(inner[i] for i in range(37 + 16, 37 + 484)) >= 2


def test_toxicity(spark):
    docs, labels = labelled(240)
    tail = "plain " * 300 + "you odious blockhead"
    edge = [(1000, None), (1001, ""), (1002, tail), (None, "some plain words")]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, docs + edge)
    out = {r.doc_id: r.score for r in toxicity_gru.scored(df, toxicity_gru.fit(df, lab)).collect()}
    held = [(i, t) for i, _, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(out[i] >= toxicity_gru.CUT) == t for i, t in held]) > 0.9
    assert out[1000] == out[1001] == 0
    assert out[1002] >= toxicity_gru.CUT
    assert all(r.score == 0 for r in toxicity_gru.scored(df, toxicity_gru.fit(df, lab.limit(0))).collect())
    assert toxicity_gru.scored(frame(spark, []), toxicity_gru.ToxicityModel()).count() == 0
