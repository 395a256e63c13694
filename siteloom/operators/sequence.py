"""Operators on sequences: consensus, bases from a reference, coding consequences of single sites."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import alleles as al
from siteloom.operators.carried import carried, ranged
from siteloom.operators.ranges import overlap_join

#: The standard genetic code in the order T, C, A, G of the three bases (fixed values).
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate(seq: str) -> str:
    """Protein of a coding sequence; X for codons with other letters."""
    at = {b: i for i, b in enumerate("TCAG")}
    out = []
    for i in range(0, len(seq) - 2, 3):
        c = seq[i : i + 3].upper()
        out.append(AMINO_ACIDS[16 * at[c[0]] + 4 * at[c[1]] + at[c[2]]] if all(x in at for x in c) else "X")
    return "".join(out)


def reverse_complement(c: Column) -> Column:
    return F.reverse(F.translate(c, "ACGTacgt", "TGCAtgca"))


def chunked(fasta: DataFrame, width: int) -> DataFrame:
    """(chrom, chunk, seq) from (chrom, seq): the reference in pieces, for joins by position."""
    n = F.ceil(F.length("seq") / width).cast("int")
    e = fasta.where(F.length("seq") > 0).select("chrom", "seq", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return e.select("chrom", F.col("chunk").cast("long").alias("chunk"), F.substr("seq", F.col("chunk") * width + 1, F.lit(width)).alias("seq"))


def fill_from_reference(df: DataFrame, chunks: DataFrame, width: int, column: str = "AA") -> DataFrame:
    """The reference base at each position, by an equi-join on (contig, chunk)."""
    t = df.withColumn("chunk", F.floor((F.col("pos") - 1) / width))
    j = t.join(chunks.withColumnRenamed("seq", "_seq"), ["chrom", "chunk"], "left")
    return j.withColumn(column, F.upper(F.substr("_seq", ((F.col("pos") - 1) % width + 1).cast("int"), F.lit(1)))).drop("_seq", "chunk")


def consensus(df: DataFrame, chunks: DataFrame, width: int, sample: int | None = None, mask: DataFrame | None = None, iupac: bool = False) -> DataFrame:
    """(chrom, chunk, seq): the reference with the variants applied, chunk by chunk.

    Of overlapping variants the first is applied. A deletion that reaches into the next chunk takes its bases there. With a
    ``sample`` its first ALT allele counts (or the IUPAC code of single bases), else the first ALT. Masked positions are N.
    """
    from siteloom.functions import genotype as g

    alt = F.get("alts", F.lit(0))
    t = df
    if sample is not None:
        s = F.get("samples", F.lit(sample))
        t = t.where(g.has_alt(s["GT"]))
        alt = F.get("alts", F.get(F.filter(s["GT"]["alleles"], lambda a: a > 0), F.lit(0)) - 1)
        if iupac:
            alt = F.when((F.length("ref") == 1) & (F.length(alt) == 1) & ~g.is_missing(s["GT"]), al.iupac(F.col("ref"), F.col("alts"), s["GT"]["alleles"])).otherwise(alt)
    t = t.select("chrom", "pos", "ref", alt.alias("alt")).where(F.col("alt").rlike("^[A-Za-z]+$"))
    order = ["pos", "ref", "alt"]
    t = carried(ranged(t, ["chrom"], order), ["chrom"], order, maxima={"_reach": F.col("pos") + F.length("ref") - 1}, inclusive=False)
    t = t.where("_reach is null or pos > _reach").select("chrom", *order)
    # each variant goes to the chunks that its REF touches
    last = F.floor((F.col("pos") + F.length("ref") - 2) / width)
    edits = t.select("*", F.explode(F.sequence(F.floor((F.col("pos") - 1) / width), last)).alias("chunk")).groupBy("chrom", "chunk").agg(F.collect_list(F.struct("pos", "ref", "alt")).alias("edits"))
    j = chunks.join(edits, ["chrom", "chunk"], "left")
    if mask is not None:
        m = mask.select("chrom", "beg", "end", F.explode(F.sequence(F.floor((F.col("beg") - 1) / width), F.floor((F.col("end") - 1) / width))).alias("chunk")).groupBy("chrom", "chunk").agg(F.collect_list(F.struct("beg", "end")).alias("masks"))
        j = j.join(m, ["chrom", "chunk"], "left")
    else:
        j = j.withColumn("masks", F.lit(None).cast("array<struct<beg:bigint,end:bigint>>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for chrom, chunk, seq, edits_, masks in p[["chrom", "chunk", "seq", "edits", "masks"]].itertuples(index=False):
                base = list(seq)
                start = int(chunk) * width
                for m in masks if masks is not None else []:
                    for i in range(max(0, m["beg"] - 1 - start), min(len(base), m["end"] - start)):
                        base[i] = "N"
                for e in sorted(edits_ if edits_ is not None else [], key=lambda e: e["pos"]):
                    at = e["pos"] - 1 - start
                    for i in range(len(e["ref"])):
                        if 0 <= at + i < len(base):
                            base[at + i] = (e["alt"][i] if i < len(e["ref"]) - 1 else e["alt"][i:]) if i < len(e["alt"]) else ""
                out.append((chrom, int(chunk), "".join(base)))
            yield pd.DataFrame(out, columns=["chrom", "chunk", "seq"])

    return j.mapInPandas(run, "chrom string, chunk long, seq string")


def frameshifts(df: DataFrame, exons: DataFrame) -> DataFrame:
    """Indels in exons (chrom, beg, end) with ``frameshift``: whether the length change isn't a multiple of three."""
    d = F.length(F.get("alts", F.lit(0))) - F.length("ref")
    indels = df.where(F.exists(al.variant_types(F.col("ref"), F.col("alts")), lambda t: t == "indel") & F.get("alts", F.lit(0)).rlike("^[A-Za-z]+$"))
    return overlap_join(indels, exons, how="semi").withColumn("frameshift", d % 3 != 0)


def consequences(df: DataFrame, cds: DataFrame) -> DataFrame:
    """chrom, pos, ref, alt, transcript, consequence of single sites in coding parts.

    ``cds``: transcript, chrom, beg, end, strand, offset (bases of the transcript's coding sequence before this part, in
    its direction) and seq (the whole coding sequence, in the direction of the transcript). Each site is taken alone.
    """
    e = df.select("chrom", "pos", (F.col("pos") + F.length("ref") - 1).alias("end"), "ref", F.explode("alts").alias("alt")).where(F.col("alt").rlike("^[A-Za-z]+$"))
    j = overlap_join(e, cds)
    cols = ["chrom", "pos", "ref", "alt", "r_transcript", "r_beg", "r_end", "r_strand", "r_offset", "r_seq"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flip = str.maketrans("ACGT", "TGCA")
        for p in batches:
            out = []
            for chrom, pos, ref, alt, tr, beg, end, strand, offset, seq in p[cols].itertuples(index=False):
                r, a = ref.upper(), alt.upper()
                if pos < beg or pos + len(r) - 1 > end:
                    kind = "splice_or_boundary"
                else:
                    at = offset + (pos - beg if strand == "+" else end - (pos + len(r) - 1))
                    if strand == "-":
                        r, a = r.translate(flip)[::-1], a.translate(flip)[::-1]
                    d = len(a) - len(r)
                    if d % 3:
                        kind = "frameshift"
                    elif d:
                        kind = "inframe_insertion" if d > 0 else "inframe_deletion"
                    else:
                        new = seq[:at] + a + seq[at + len(r) :]
                        x, y = translate(seq), translate(new)
                        k = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), None)
                        kind = ("stop_retained" if at // 3 == len(x) - 1 and x.endswith("*") else "synonymous") if k is None else "start_lost" if k == 0 else "stop_gained" if y[k] == "*" else "stop_lost" if x[k] == "*" else "missense"
                out.append((chrom, pos, ref, alt, tr, kind))
            yield pd.DataFrame(out, columns=["chrom", "pos", "ref", "alt", "transcript", "consequence"])

    return j.select(*cols).mapInPandas(run, "chrom string, pos long, ref string, alt string, transcript string, consequence string")


#: Consequence terms of the public sequence ontology from mild to severe; those of one line are as severe.
SEVERITY = [
    ["intergenic"],
    ["feature_truncation", "feature_elongation"],
    ["regulatory"],
    ["TF_binding_site", "TFBS"],
    ["downstream", "upstream"],
    ["non_coding_transcript", "non_coding"],
    ["intron", "NMD_transcript"],
    ["non_coding_transcript_exon"],
    ["5_prime_utr", "3_prime_utr"],
    ["coding_sequence", "mature_miRNA"],
    ["stop_retained", "start_retained", "synonymous"],
    ["incomplete_terminal_codon"],
    ["splice_region"],
    ["missense", "inframe", "protein_altering"],
    ["transcript_amplification"],
    ["exon_loss"],
    ["disruptive"],
    ["start_lost", "stop_lost", "stop_gained", "frameshift"],
    ["splice_acceptor", "splice_donor"],
    ["transcript_ablation"],
]


def split_consequences(df: DataFrame, column: Column, fields: list[str], select: str = "all", least: str | None = None, consequence: str = "Consequence") -> DataFrame:
    """Annotations ``a|b|c,a|b|c`` exploded to columns; ``select``: all or worst; ``least``: a severity to reach.

    Terms joined by ``&`` count with the most severe (or, for ``least`` and ``worst``, so does the whole annotation). A
    term is known by its exact name, else by the mildest name it contains, upper and lower case alike; unknown terms are
    the most severe. Of equally severe annotations the first one of the list is the worst.
    """
    parts = df.select("*", F.posexplode(F.split(column, ",", -1)).alias("_at", "_t")).withColumn("_f", F.split("_t", r"\|", -1))
    for i, f in enumerate(fields):
        parts = parts.withColumn(f, F.nullif(F.get("_f", F.lit(i)), F.lit("")))
    names = [(t.lower(), i) for i, group in enumerate(SEVERITY) for t in group]
    exact = F.create_map(*[F.lit(x) for pair in names for x in pair])

    def score(t: Column) -> Column:
        out = F.lit(len(SEVERITY))
        for name, i in reversed(names):
            out = F.when(F.contains(t, F.lit(name)), i).otherwise(out)
        return F.coalesce(F.try_element_at(exact, t), out)

    sev = F.array_max(F.transform(F.split(F.lower(F.coalesce(consequence, F.lit(""))), "&"), score))
    out = parts.withColumn("severity", sev).drop("_t", "_f")
    if least:
        out = out.where(F.col("severity") >= dict(names)[least.lower()])
    if select == "worst":
        keys = [c for c in ("chrom", "pos", "ref", "alts") if c in df.columns]
        w = Window.partitionBy(*keys).orderBy(F.desc("severity"), "_at")
        out = out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return out.drop("_at")
