"""Haplotype consequences against whole translations of the changed sequences."""

import random

import pytest

from siteloom.operators import haplotypes as hp
from siteloom.operators.sequence import translate
from tests.test_variants import frame, site

FLIP = str.maketrans("ACGT", "TGCA")


def random_case(r, forward=True, indels=True):
    """A genome, a transcript of three parts, and sites inside its parts, a few codons apart at least or close together."""
    parts = [(41, 82), (121, 155), (201, 231)]
    while True:  # a reference without stops
        genome = "".join(r.choice("ACGT") for _ in range(400))
        spliced = "".join(genome[b - 1 : e] for b, e in parts)
        if "*" not in translate(spliced if forward else spliced.translate(FLIP)[::-1]):
            break
    length = sum(e - b + 1 for b, e in parts)
    assert length % 3 == 0
    rows, pos = [], 45
    while pos < 226:
        pos += r.randint(1, 9)
        part = next((p for p in parts if p[0] + 4 <= pos <= p[1] - 8), None)
        if part is None:
            continue
        kind = r.choice(["snp", "snp", "ins", "del", "mnp"]) if indels else "snp"
        ref = genome[pos - 1]
        if kind == "snp":
            alt = r.choice([b for b in "ACGT" if b != ref])
        elif kind == "ins":
            alt = ref + "".join(r.choice("ACGT") for _ in range(r.randint(1, 4)))
        elif kind == "del":
            ref, alt = genome[pos - 1 : pos + r.randint(1, 4)], genome[pos - 1]
        else:
            ref = genome[pos - 1 : pos + 1]
            alt = ref.translate(FLIP)
        rows.append((pos, ref, alt))
        pos += len(ref)
    strand = "+" if forward else "-"
    ordered = parts if forward else parts[::-1]
    spliced = [genome[b - 1 : e] for b, e in parts]
    seq = "".join(spliced) if forward else "".join(spliced).translate(FLIP)[::-1]
    tail = genome[231 : 231 + hp.TAIL] if forward else genome[40 - hp.TAIL : 40].translate(FLIP)[::-1]
    return genome, parts, rows, hp.Model(strand, ordered, seq + tail, False), seq


def changed(genome, parts, rows, forward):
    out, at = [], 0
    for pos, ref, alt in sorted(rows):
        out += [genome[at : pos - 1], alt]
        at = pos - 1 + len(ref)
    out.append(genome[at:])
    # lengths of the parts after the changes
    shift = lambda lo, hi: sum(len(a) - len(r) for p, r, a in rows if lo <= p <= hi)
    whole, pieces, moved = "".join(out), [], 0
    for b, e in parts:
        pieces.append(whole[b - 1 + moved : e + moved + shift(b, e)])
        moved += shift(b, e)
    seq = "".join(pieces)
    return seq if forward else seq.translate(FLIP)[::-1]


def upto_stop(protein):
    return protein.split("*")[0]


@pytest.mark.parametrize("seed", range(60))
def test_units_give_the_protein_of_the_whole_haplotype(seed):
    """The protein put together from the units of a haplotype is the translation of its sequence, up to its first stop."""
    r = random.Random(seed)
    forward = bool(seed % 2)
    genome, parts, rows, model, seq = random_case(r, forward)
    placed = {x: model.placed(*x) for x in rows}
    assert all(c is not None and c.inside for c in placed.values())
    inside = sorted(placed.values(), key=lambda c: c.start)
    tree = hp.Tree(model, inside)
    paths = [tuple(sorted(r.sample(range(len(inside)), r.randint(1, len(inside))))) for _ in range(12)]
    found = dict(tree.walk(sorted(set(paths))))
    assert set(found) == set(paths)
    for path, units in found.items():
        mine = [x for x in rows if placed[x] in [inside[i] for i in path]]
        want = upto_stop(translate(changed(genome, parts, mine, forward)))
        protein, moved = translate(seq), 0
        for unit, (name, amino, dna, _) in units:
            old, _, new = amino.partition(">")
            at = int("".join(ch for ch in old if ch.isdigit())) - 1
            old = old.lstrip("0123456789")
            new = new.lstrip("0123456789") if new else old
            lost = len(translate(seq)) - at if "frameshift" in name and name.lstrip("*") != "start_lost" else len(old)
            protein = protein[: at + moved] + new + protein[at + moved + lost :]
            moved += len(new) - lost
            assert dna.count("+") == len(unit) - 1
            if "*" in new:
                break  # nothing after it is made
        if any(not a for _, (_, a, _, _) in units):
            continue  # a start that is lost with the frame has no protein
        assert upto_stop(protein) == want


def test_prefixes_are_translated_once(monkeypatch):
    r = random.Random(3)
    _, _, rows, model, _ = random_case(r, True, indels=False)
    inside = sorted((model.placed(*x) for x in rows), key=lambda c: c.start)
    calls = []
    told = hp.Model.told
    monkeypatch.setattr(hp.Model, "told", lambda self, *a: calls.append(a) or told(self, *a))
    n = min(8, len(inside))
    tree = hp.Tree(model, inside)
    paths = [tuple(i for i in range(n) if mask >> i & 1) for mask in range(1, 1 << n)]
    assert len(list(tree.walk(paths))) == len(paths)
    assert len(calls) <= 4 * n * n  # not one for each haplotype


def test_compound_and_phased(spark):
    """Two SNPs of one codon on one copy are one consequence, on two copies they are two; frames that meet again; both strands."""
    #             1         2         3
    #    123456789012345678901234567890
    seq = "CCCCCATGAAAGGGTTTCCCTAACCCCCCC"
    chunks = spark.createDataFrame([("1", k, seq[k * 7 : k * 7 + 7]) for k in range(5)] + [("2", k, seq.translate(FLIP)[::-1][k * 7 : k * 7 + 7]) for k in range(5)], "chrom string, chunk long, seq string")
    cds = spark.createDataFrame([("T1", "G", "protein_coding", "1", 6, 23, "+", 0), ("T2", "H", "protein_coding", "2", 8, 25, "-", 0)], "transcript string, gene string, biotype string, chrom string, beg long, end long, strand string, phase int")
    models = hp.coding_models(cds, chunks, 7)
    got = {m.transcript: m for m in models.collect()}
    assert got["T1"].seq == seq[:30][5 - got["T1"].head : 30][: len(got["T1"].seq)] and got["T1"].head == 5
    assert got["T2"].seq[got["T2"].head :][:18] == "ATGAAAGGGTTTCCCTAA" and got["T2"].head == 5
    rows = [site(9, "A", ("C",), samples=(("1|0", 1, None), ("0|1", 1, None))), site(10, "A", ("G",), samples=(("1|0", 1, None), ("1|0", 1, None)))]
    told = hp.haplotype_consequences(frame(spark, rows), models).collect()
    mine = {(x.sample, x["copy"], x.pos): x.consequence for x in told}
    assert mine == {
        (0, 0, 9): "missense|G|T1|protein_coding|+|2K>2R|9A>C+10A>G", (0, 0, 10): "@9",
        (1, 1, 9): "missense|G|T1|protein_coding|+|2K>2Q|9A>C", (1, 0, 10): "missense|G|T1|protein_coding|+|2K>2R|10A>G",
    }
    rows = [site(11, "AG", ("A",), samples=(("1|0", 1, None), ("1|1", 1, None))), site(15, "T", ("TA",), samples=(("1|0", 1, None), ("0|0", 1, None)))]
    mine = {(x.sample, x["copy"], x.pos): x.consequence for x in hp.haplotype_consequences(frame(spark, rows), models).collect()}
    assert mine[0, 0, 11].startswith("missense&inframe_altering|G|T1|protein_coding|+|2KGF>2KGI|") and mine[0, 0, 15] == "@11"
    assert mine[1, 0, 11].startswith("frameshift") and mine[1, 0, 11] == mine[1, 1, 11]
    tag = {(x.pos, x.sample): x.tbcsq for x in hp.haplotype_tag(None, hp.haplotype_consequences(frame(spark, rows), models)).collect()}
    assert tag[15, 0] == "@11"
    # the other strand: start, stop, and a stop that silences what follows
    rows = [site(25, "T", ("C",), chrom="2", samples=(("1|0", 1, None), ("0|0", 1, None))), site(8, "T", ("A",), chrom="2", samples=(("1|0", 1, None), ("0|0", 1, None))), site(22, "T", ("A",), chrom="2", samples=(("0|1", 1, None), ("0|0", 1, None))), site(14, "A", ("T",), chrom="2", samples=(("0|1", 1, None), (None, 1, None)))]
    mine = {(x["copy"], x.pos): x.consequence for x in hp.haplotype_consequences(frame(spark, rows), models).collect()}
    assert mine[0, 25] == "start_lost|H|T2|protein_coding|-|1M>1V|25T>C" and mine[0, 8].startswith("stop_lost|H|T2|protein_coding|-|6*>6Y")
    assert mine[1, 22] == "stop_gained|H|T2|protein_coding|-|2K>2*|22T>A" and mine[1, 14].startswith("*missense|H|T2")


def test_parts_of_large_transcripts_agree(spark, monkeypatch):
    """A transcript's haplotypes translated by one task or by several; odd alleles, nulls and repeated sites."""
    r = random.Random(11)
    genome, parts, rows, _, _ = random_case(r, True)
    gts = ["0|1", "1|0", "1|1", "0|0", "./.", None, "0/1"]
    sites = [site(p, ref, (alt,), samples=tuple((r.choice(gts), 1, None) for _ in range(25))) for p, ref, alt in rows]
    sites += [site(60, "A", ("<DEL>",), samples=(("1|1", 1, None),) * 25), site(61, "A", None, samples=((None, 1, None),) * 25)]
    chunks = spark.createDataFrame([("1", k, genome[k * 50 : k * 50 + 50]) for k in range(8)], "chrom string, chunk long, seq string")
    cds = spark.createDataFrame([("T", None, None, "1", b, e, "+", None) for b, e in parts], "transcript string, gene string, biotype string, chrom string, beg long, end long, strand string, phase int")
    models = hp.coding_models(cds, chunks, 50)
    schema_sites = [x[:6] + ([] if x[6] is None else x[6],) + x[7:] for x in ((*s[:6], s[6], *s[7:]) for s in sites)]
    df = frame(spark, schema_sites)
    one = sorted(map(str, hp.haplotype_consequences(df, models).collect()))
    twice = sorted(map(str, hp.haplotype_consequences(df.unionByName(df), models).collect()))
    monkeypatch.setattr(hp, "HAPLOTYPES", 3)
    many = sorted(map(str, hp.haplotype_consequences(df, models).collect()))
    assert one == many == twice and len(one) > 50
    assert len(hp.haplotype_consequences(df, models, unphased="skip").collect()) < len(one)
    assert hp.haplotype_consequences(df.where("false"), models).count() == 0 and hp.haplotype_consequences(df, models.where("false")).count() == 0
