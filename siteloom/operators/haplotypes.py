"""Coding consequences of whole haplotypes: variants of one chromosome copy that share codons or a reading frame are
translated together.

The work is laid out by transcripts. Each carrier of ALT alleles in a transcript gives one haplotype (an array of its
variants); equal haplotypes are grouped first, so what is translated is the distinct haplotypes of a transcript. They meet
the transcript's coding sequence in a cogroup, cut into parts of at most :data:`HAPLOTYPES` on average by a salt. There they
form a prefix tree from the start codon on: haplotypes in order share the frames of their common beginning, and only codons
that a variant touches are translated (after a frameshift, those up to the next stop).

Terms: a *part* is a coding piece of a transcript, a *change* is one ALT placed in a transcript, in the transcript's own
direction, and a *unit* is a run of changes that are told as one consequence: the next change belongs to it while the
reading frame is off, or if both lie in one codon.

Defined results: null and symbolic alleles, and alleles with letters other than A, C, G, T and N, have no consequence; of
changes that overlap on one haplotype the later one is left out. Unphased genotypes count as they are written, or are left
out (``unphased="skip"``). Repeated sites count once. Transcripts without a reference sequence have no consequences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siteloom.operators.ranges import overlap_join
from siteloom.operators.sequence import translate

#: The consequence terms, in the order in which they are told.
TERMS = [
    "synonymous", "missense", "stop_lost", "stop_gained", "inframe_deletion", "inframe_insertion", "frameshift", "splice_acceptor", "splice_donor", "start_lost", "splice_region", "stop_retained",
    "inframe_altering", "coding_sequence", "feature_elongation", "feature_truncation", "start_retained",
]
#: Bases of an intron that are its donor or acceptor, up to where its region reaches, and of an exon that belong to it.
SITE, INTRON_REGION, EXON_REGION = 2, 8, 3
#: Bases that are kept after the coding sequence, to fill its last codon, and before it, to see that a deletion spares the start.
TAIL, HEAD = 10, 60
HAPLOTYPES = 10_000
#: What happens to the start or the stop is told together with the splice terms of its changes, other consequences apart.
ENDS = {"start_lost", "start_retained", "stop_lost", "stop_retained"}
#: Terms that are told with the strand, unless a splice term is among them.
CODING = ENDS | {"synonymous", "missense", "stop_gained", "inframe_deletion", "inframe_insertion", "frameshift", "inframe_altering"}
_FLIP = str.maketrans("ACGTN", "TGCAN")
FIELDS = "transcript string, haplotype string, pos long, ref string, alt string, told_at long, consequence string, amino string, dna string"


# --- models
def coding_models(cds: DataFrame, chunks: DataFrame, width: int) -> DataFrame:
    """One row a transcript: chrom, strand, gene, biotype, its parts and its coding sequence in its own direction.

    ``cds``: transcript, gene, biotype, chrom, beg, end, strand, phase of each part (1-based, inclusive); ``chunks``: the
    reference as (chrom, chunk, seq) in pieces of ``width``. A first part with a phase loses those bases, and has no start;
    a sequence that ends inside a codon loses the rest, and has no stop.
    """
    forward = F.col("strand") != "-"
    order = Window.partitionBy("transcript").orderBy(F.when(forward, F.col("beg")).otherwise(-F.col("end")))
    t = cds.withColumn("_n", F.row_number().over(order)).withColumn("_last", F.row_number().over(Window.partitionBy("transcript").orderBy(F.when(forward, -F.col("end")).otherwise(F.col("beg")))) == 1)
    cut = F.when(F.col("_n") == 1, F.coalesce(F.col("phase"), F.lit(0))).otherwise(0)
    t = t.withColumn("_cut", cut).withColumn("beg", F.when(forward, F.col("beg") + F.col("_cut")).otherwise(F.col("beg"))).withColumn("end", F.when(forward, F.col("end")).otherwise(F.col("end") - F.col("_cut")))
    tail = F.when(F.col("_last"), F.lit(TAIL)).otherwise(0)
    head = F.when(F.col("_n") == 1, F.lit(HEAD)).otherwise(0)
    t = t.withColumn("_from", F.greatest(F.col("beg") - F.when(forward, head).otherwise(tail), F.lit(1))).withColumn("_to", F.col("end") + F.when(forward, tail).otherwise(head))
    pieces = t.select("*", F.explode(F.sequence(F.floor((F.col("_from") - 1) / width), F.floor((F.col("_to") - 1) / width))).alias("chunk")).join(chunks.select("chrom", "chunk", F.upper("seq").alias("_seq")), ["chrom", "chunk"])
    begin = F.greatest(F.col("_from") - 1 - F.col("chunk") * width, F.lit(0))
    stop = F.least(F.col("_to") - F.col("chunk") * width, F.lit(width))
    piece = F.substr("_seq", (begin + 1).cast("int"), (stop - begin).cast("int"))
    of_part = pieces.groupBy("transcript", "_n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", piece.alias("s")))), lambda x: x["s"]), "").alias("seq"), *[F.first(c).alias(c) for c in ("gene", "biotype", "chrom", "strand", "beg", "end", "_cut", "_from", "_last")])
    flipped = F.when(F.col("strand") == "-", F.reverse(F.translate("seq", "ACGTN", "TGCAN"))).otherwise(F.col("seq"))
    # how much of it lies before the coding sequence: less at the ends of a contig
    before = F.when(F.col("_n") == 1, F.when(F.col("strand") == "-", F.length("seq") - (F.col("end") - F.col("_from") + 1)).otherwise(F.col("beg") - F.col("_from"))).otherwise(0)
    row = F.struct("_n", "beg", "end", flipped.alias("seq"), "_cut", F.greatest(before, F.lit(0)).cast("int").alias("head"))
    g = of_part.groupBy("transcript").agg(*[F.first(c).alias(c) for c in ("gene", "biotype", "chrom", "strand")], F.array_sort(F.collect_list(row)).alias("_parts"))
    return g.select(
        "transcript", "gene", "biotype", "chrom", "strand", (F.get("_parts", F.lit(0))["_cut"] > 0).alias("no_start"),
        F.transform("_parts", lambda p: F.struct(p["beg"].alias("beg"), p["end"].alias("end"))).alias("parts"), F.array_join(F.transform("_parts", lambda p: p["seq"]), "").alias("seq"),
        F.get("_parts", F.lit(0))["head"].alias("head"),
    )


@dataclass(frozen=True)
class Change:
    """An ALT in a transcript: where its REF begins in the coding sequence, both alleles in its direction, what else it hits.

    ``inside``: it changes the coding sequence and nothing else has to be known to translate it.
    """

    pos: int
    text: str
    start: int
    ref: str
    alt: str
    inside: bool
    hits: frozenset[str]

    @property
    def shift(self) -> int:
        return len(self.alt) - len(self.ref)

    @property
    def last(self) -> int:
        """The last coding base that it changes, from its start in the changed sequence; after a deletion the base that follows."""
        return len(self.alt) - 1 if self.shift >= 0 else len(self.alt)


class Model:
    """A transcript's coding sequence, and where the genome's positions lie in it."""

    def __init__(self, strand: str, parts: list[tuple[int, int]], seq: str, no_start: bool, head: int = 0) -> None:
        self.forward, self.parts = strand != "-", parts
        self.before, seq = seq[:head], seq[head:]
        length = sum(e - b + 1 for b, e in parts)
        self.no_stop = length % 3 != 0
        self.length = length - length % 3
        self.padded = seq
        self.no_start = no_start or translate(seq[:3]) != "M"
        self.offsets, at = [], 0
        for b, e in parts:
            self.offsets.append(at)
            at += e - b + 1

    def placed(self, pos: int, ref: str, alt: str) -> Change | None:
        """The change that an allele makes, or None if it is none or far from the coding parts."""
        text = f"{pos}{ref}>{alt}"
        r, a = ref.upper(), alt.upper()
        if r == a or not r or not a or set(r + a) - set("ACGTN"):
            return None
        keep = 0 if len(r) == len(a) else 1  # an indel keeps the base before it
        while min(len(r), len(a)) > keep and r[-1] == a[-1]:
            r, a = r[:-1], a[:-1]
        while len(r) > keep and len(a) > keep and r[0] == a[0] and (keep == 0 or r[1:2] == a[1:2]):
            r, a, pos = r[1:], a[1:], pos + 1
        anchored = keep == 1 and r[0] == a[0]
        insertion = anchored and len(r) == 1
        # what is changed: bases first..last, or the gap after `first`
        first, last = (pos + 1 if anchored and not insertion else pos), pos + len(r) - 1
        hits, inside = set(), False
        for i, (b, e) in enumerate(self.parts):
            before, after = (i > 0, i < len(self.parts) - 1) if self.forward else (i < len(self.parts) - 1, i > 0)
            hits |= self._edges(first, last, b, e, before, after, insertion)
            # what is inserted before the first base of a part with an intron there belongs to the part
            here = b - before <= first < e if insertion else first <= e and last >= b
            if here and (insertion or b <= pos and last <= e):
                if pos < b:
                    r, a, pos = "", a[1:], b
                start = self.offsets[i] + (pos - b if self.forward else e - (pos + len(r) - 1))
                inside = start + len(r) <= self.length
                if inside and not self.forward:
                    r, a = r.translate(_FLIP)[::-1], a.translate(_FLIP)[::-1]
            elif here and not inside:  # it reaches over the end of a part, or has its first base outside
                gone = min(last, e) - max(first, b) + 1
                hits.add("coding_sequence" if first < b or len(r) <= len(a) else "frameshift" if gone % 3 else "inframe_deletion")
                at = self.offsets[i] + (max(first, b) - b if self.forward else e - min(last, e))
                if at < 3 and not self.no_start:
                    hits.add("start_lost")
                    hits.discard("frameshift")
                if at + gone > self.length - 3 and not self.no_stop:
                    hits.add("stop_lost")
        if anchored and not insertion and self._spares_start(first, last):
            return Change(pos, text, -1, r, a, False, frozenset({"start_retained"}))
        if not inside:
            return Change(pos, text, -1, r, a, False, frozenset(hits)) if hits else None
        if min(len(r), len(a)) > 1 and len(r) != len(a) and not anchored:
            hits.add("feature_elongation" if len(a) > len(r) else "feature_truncation")
        return Change(pos, text, start, r, a, True, frozenset(hits))

    def _spares_start(self, first: int, last: int) -> bool:
        """Whether a deletion that takes bases of the start codon is the same as one of as many bases just before it."""
        b, e = self.parts[0]
        at, n = first - b if self.forward else e - last, last - first + 1
        if self.no_start or at > 2 or at + n <= 0:
            return False
        around, k = self.before + self.padded, len(self.before) + at
        return k >= n and around[k : k + n] == around[k - n : k]

    def _edges(self, first: int, last: int, b: int, e: int, before: bool, after: bool, insertion: bool) -> set[str]:
        """Splice terms by distance from the ends of a part that have an intron."""
        meets = (lambda lo, hi: lo <= first < hi) if insertion else (lambda lo, hi: first <= hi and last >= lo)
        hits = set()
        if after:
            site = (e, e + SITE) if insertion else (e + 1, e + SITE)
            region = (e + SITE, e + INTRON_REGION) if insertion else (e + SITE + 1, e + INTRON_REGION)
            if meets(*site):
                hits.add("splice_donor" if self.forward else "splice_acceptor")
            if meets(*region) or meets(e - EXON_REGION + 1, e):
                hits.add("splice_region")
        if before:
            site = (b - SITE, b - 1)
            region = (b - INTRON_REGION, b - SITE) if insertion else (b - INTRON_REGION, b - SITE - 1)
            if meets(*site):
                hits.add("splice_acceptor" if self.forward else "splice_donor")
            if meets(*region) or (b - 1 <= first < b + EXON_REGION if insertion else meets(b, b + EXON_REGION - 1)):
                hits.add("splice_region")
        return hits

    def told(self, unit: tuple[Change, ...], shift: int, after_stop: bool) -> tuple[str, str, str, bool]:
        """Terms, amino acids and DNA of a unit; whether a stop comes before what follows.

        ``shift``: by how much the changes before have moved the sequence, a multiple of three.
        """
        begin, end = unit[0].start, unit[-1].start + len(unit[-1].ref)
        middle, at = [], begin
        for c in unit:
            middle += [self.padded[at : c.start], c.alt]
            at = c.start + len(c.ref)
        moved = sum(c.shift for c in unit)
        pad = begin % 3
        new = self.padded[begin - pad : begin] + "".join(middle)
        old = self.padded[begin - pad : end]
        if moved % 3:
            need = -len(new) % 3
            new += self.padded[end : max(self.length, end + need)]
            old += self.padded[end : self.length]
        else:
            new += self.padded[end : end + -len(new) % 3]
            old += self.padded[end : end + -len(old) % 3]
        was, now = translate(old), translate(new)
        was, now = (x[: x.index("*") + 1] if "*" in x else x for x in (was, now))
        terms = {h for c in unit for h in c.hits if h.startswith("feature")}
        starts = not self.no_start and begin < 3
        stops = not self.no_stop and end > self.length - 3
        if moved:
            terms.add("frameshift" if moved % 3 else "inframe_deletion" if moved < 0 else "inframe_insertion")
            if not was.endswith("*") and now.endswith("*"):
                terms.add("stop_gained")
        else:
            if any(c.shift for c in unit):
                terms.add("inframe_altering")
            for x, y in zip(was, now, strict=False):
                if x != y:
                    terms.add("stop_lost" if x == "*" else "stop_gained" if y == "*" else "missense")
            if was == now:
                terms.add("synonymous")
        if len(unit) > 1 and terms & {"inframe_deletion", "inframe_insertion", "inframe_altering"} and now.endswith("*"):
            terms -= {"inframe_deletion", "inframe_insertion", "inframe_altering"}
            terms |= {"frameshift", "stop_gained"}
        if stops:
            if was.endswith("*") and now.endswith("*"):
                terms = (terms - {"stop_lost", "synonymous"}) | {"stop_retained"}
            elif was.endswith("*"):
                terms.add("stop_lost")
            elif now.endswith("*"):  # a sequence that doesn't end in a stop isn't known to its end
                terms = (terms - {"stop_gained"}) | {"stop_retained"}
        plain = False
        if starts:
            if was[:1] == "M" == now[:1]:
                terms = (terms - {"synonymous"}) | {"start_retained"} if moved else terms
            else:
                plain = "frameshift" in terms
                terms = (terms - {"frameshift"}) | {"start_lost"}
        if terms & {"start_lost", "stop_lost", "stop_gained"}:
            terms.discard("missense")
        if terms & ENDS:
            terms |= {h for c in unit for h in c.hits}
        name = ("*" if after_stop else "") + "&".join(t for t in TERMS if t in terms)
        if plain:
            return name, "", "", after_stop or now.endswith("*")
        amino = f"{begin // 3 + 1}{was}" + ("" if was == now and not moved else f">{(begin + shift) // 3 + 1}{now}")
        return name, amino, "+".join(c.text for c in sorted(unit, key=lambda c: c.pos)), after_stop or now.endswith("*")


@dataclass(frozen=True)
class _Frame:
    """A node of the prefix tree: units told so far, the one that is open, and what lies before it."""

    told: tuple[tuple[tuple[int, ...], tuple[str, str, str, bool]], ...] = ()
    open: tuple[int, ...] = ()
    shift: int = 0
    after_stop: bool = False
    end: int = 0


class Tree:
    """The haplotypes of one transcript, walked in order so that common beginnings are translated once."""

    def __init__(self, model: Model, changes: list[Change]) -> None:
        self.model, self.changes = model, changes
        self.known: dict[tuple[tuple[int, ...], int, bool], tuple[str, str, str, bool]] = {}

    def _closed(self, f: _Frame) -> _Frame:
        if not f.open:
            return f
        key = (f.open, f.shift, f.after_stop)
        if key not in self.known:
            self.known[key] = self.model.told(tuple(self.changes[i] for i in f.open), f.shift, f.after_stop)
        out = self.known[key]
        return _Frame((*f.told, (f.open, out)), (), f.shift + sum(self.changes[i].shift for i in f.open), out[3], f.end)

    def _with(self, f: _Frame, i: int) -> _Frame:
        c = self.changes[i]
        if f.open:
            moved = sum(self.changes[k].shift for k in f.open)
            before = self.changes[f.open[-1]]
            # both in the changed sequence
            last = before.start + before.last + f.shift + moved - before.shift
            if moved % 3 == 0 and last // 3 != (c.start + f.shift + moved) // 3:
                f = self._closed(f)
        return _Frame(f.told, (*f.open, i), f.shift, f.after_stop, c.start + len(c.ref))

    def walk(self, haplotypes: list[tuple[int, ...]]) -> Iterator[tuple[tuple[int, ...], tuple[tuple[tuple[int, ...], tuple[str, str, str, bool]], ...]]]:
        """Each haplotype (numbers of changes in coding order) with its units; in lexicographic order."""
        path: list[tuple[int, _Frame]] = []
        root = _Frame()
        for h in sorted(haplotypes):
            common = 0
            while common < min(len(path), len(h)) and path[common][0] == h[common]:
                common += 1
            del path[common:]
            for i in h[common:]:
                path.append((i, self._with(path[-1][1] if path else root, i)))
            yield h, self._closed(path[-1][1] if path else root).told


def _apart(changes: list[Change]) -> list[Change]:
    """Without changes that overlap an earlier one of the genome."""
    out: list[Change] = []
    reach = 0
    for c in sorted(changes, key=lambda c: c.pos):
        if c.pos >= reach:
            out.append(c)
            reach = c.pos + len(c.ref)
    return out


def _translator(key: tuple, haplotypes: pa.Table, models: pa.Table) -> pa.Table:
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    rows: list[tuple] = []
    if haplotypes.num_rows and models.num_rows:
        m = models.slice(0, 1).to_pylist()[0]
        model = Model(m["strand"], [(p["beg"], p["end"]) for p in m["parts"]], m["seq"], m["no_start"], m["head"])
        label = f"{m['gene'] or ''}|{m['transcript']}|{m['biotype'] or ''}"
        strand = "+" if model.forward else "-"
        every = haplotypes.to_pylist()
        alleles = sorted({(v["pos"], v["ref"], v["alt"]) for h in every for v in h["variants"]})
        placed = {x: model.placed(*x) for x in alleles}
        inside = sorted({c for c in placed.values() if c is not None and c.inside}, key=lambda c: (c.start, c.ref, c.alt, c.pos, c.text))
        number = {c: i for i, c in enumerate(inside)}
        source = {c: x for x, c in placed.items() if c is not None}
        tree, by_path = Tree(model, inside), {}
        for h in every:
            mine = [placed[v["pos"], v["ref"], v["alt"]] for v in h["variants"]]
            for c in (c for c in mine if c is not None and not c.inside):
                rows.append((m["transcript"], h["haplotype"], *source[c], None, "&".join(t for t in TERMS if t in c.hits) + f"|{label}" + (f"|{strand}" if c.hits & CODING and not any(t.startswith("splice") for t in c.hits) else ""), "", ""))
            path = tuple(sorted(number[c] for c in _apart([c for c in mine if c is not None and c.inside])))
            if path:
                by_path.setdefault(path, []).append(h["haplotype"])
        for path, units in tree.walk(list(by_path)):
            for unit, (name, amino, dna, _) in units:
                head = inside[unit[0]]
                for i in unit:
                    c = inside[i]
                    full = f"{name}|{label}|{strand}" + (f"|{amino}|{dna}" if dna else "")
                    apart = set() if ENDS & set(name.lstrip("*").split("&")) else {t for t in c.hits if t.startswith("splice")}
                    for h in by_path[path]:
                        if apart:
                            rows.append((m["transcript"], h, *source[c], None, "&".join(t for t in TERMS if t in apart) + f"|{label}", "", ""))
                        rows.append((m["transcript"], h, *source[c], None if i == unit[0] else source[head][0], full if i == unit[0] else f"@{source[head][0]}", amino, dna))
    columns = list(zip(*rows, strict=True)) or [[] for _ in names]
    kinds = [pa.int64() if f.endswith(" long") else pa.string() for f in FIELDS.split(", ")]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


# --- the Spark side
def carried(df: DataFrame, unphased: str = "as_is") -> DataFrame:
    """chrom, pos, end, ref, alt, sample, copy of each ALT allele that a sample carries."""
    numbered = F.transform("samples", lambda s, i: F.struct(i.alias("sample"), s["GT"].alias("gt")))
    phased = F.col("c.gt.phased") | (F.size(F.array_distinct("c.gt.alleles")) <= 1)
    rows = df.select("chrom", "pos", "ref", "alts", F.explode(F.filter(numbered, lambda x: F.exists(x["gt"]["alleles"], lambda a: a > 0))).alias("c"))
    rows = rows.where(phased) if unphased == "skip" else rows
    rows = rows.select("chrom", "pos", "ref", "alts", "c.sample", F.posexplode("c.gt.alleles").alias("copy", "a")).where("a > 0")
    return rows.select("chrom", "pos", (F.col("pos") + F.length("ref") - 1).alias("end"), "ref", F.get("alts", F.col("a") - 1).alias("alt"), "sample", "copy").where(F.col("alt").rlike("^[ACGTNacgtn]+$"))


def haplotype_consequences(df: DataFrame, models: DataFrame, unphased: str = "as_is") -> DataFrame:
    """sample, copy and :data:`FIELDS` for each ALT that a copy carries in or near a coding part.

    ``models``: of :func:`coding_models`. The consequence of a unit stands at its first change in the transcript's
    direction; the others have ``@`` and its position.
    """
    near = models.select("transcript", "chrom", F.explode("parts").alias("p")).select("transcript", "chrom", (F.col("p.beg") - INTRON_REGION - 1).alias("beg"), (F.col("p.end") + INTRON_REGION + 1).alias("end"))
    rows = carried(df, unphased)
    sites = rows.select("chrom", "pos", "end", "ref", "alt").distinct()
    met = overlap_join(sites, near).select("chrom", "pos", "ref", "alt", F.col("r_transcript").alias("transcript")).distinct()
    of_copy = rows.join(met, ["chrom", "pos", "ref", "alt"]).groupBy("transcript", "sample", "copy").agg(F.array_sort(F.collect_set(F.struct("pos", "ref", "alt"))).alias("variants"))
    of_copy = of_copy.withColumn("haplotype", F.md5(F.to_json("variants")))
    distinct = of_copy.groupBy("transcript", "haplotype").agg(F.first("variants").alias("variants"))
    # large transcripts of large cohorts are translated by several tasks, each with the model
    parts = distinct.groupBy("transcript").agg(F.ceil(F.count(F.lit(1)) / HAPLOTYPES).cast("int").alias("salts"))
    salted = distinct.join(parts, "transcript").withColumn("salt", F.pmod(F.xxhash64("haplotype"), F.col("salts")).cast("int")).drop("salts")
    copies = models.join(parts, "transcript").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    told = salted.groupBy("transcript", "salt").cogroup(copies.groupBy("transcript", "salt")).applyInArrow(_translator, FIELDS)
    return of_copy.select("transcript", "sample", "copy", "haplotype").join(told, ["transcript", "haplotype"])


def haplotype_tag(df: DataFrame, told: DataFrame) -> DataFrame:
    """chrom is not told: pos, ref, sample and ``tbcsq``, the consequences of both copies of a sample, by commas."""
    one = told.groupBy("pos", "sample", "copy").agg(F.array_sort(F.collect_set("consequence")).alias("c"))
    return one.groupBy("pos", "sample").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("copy", "c"))), lambda x: x["c"])), ",").alias("tbcsq"))
