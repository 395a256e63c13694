"""The projection language: ``%CHROM\\t%POS[\\t%SAMPLE=%GT]\\n`` to a column of text.

``[...]`` repeats its body for each sample; inside, FORMAT tags come before INFO tags of the same name. A missing value
is ``.``. A line break is added at the end if the format has none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.expr.compiler import compile_filter, compile_value
from siteloom.functions import alleles as al
from siteloom.functions import genotype as g
from siteloom.functions.stats import binom_arrays_udf
from siteloom.functions.text import general
from siteloom.schema import Tag, VariantSchema, schema_of
from siteloom.sources.vcf import info_text, record_text, sample_text

_PART = re.compile(r"%(?P<fn>[A-Za-z_]+)\((?P<arg>[^()]*(?:\([^()]*\)[^()]*)*)\)|%(?P<tag>[A-Za-z_][\w.]*(?:/[A-Za-z_]\w*)?)(?:\{(?P<i>\d+)\})?|\\(?P<esc>[nt\\])|(?P<open>\[)|(?P<close>\])|(?P<text>[^%\\\[\]]+|.)", re.S)


def _text(c: Column, real: bool = False) -> Column:
    return F.coalesce(general(c) if real else c.cast("string"), F.lit("."))


def _list(c: Column, real: bool = False) -> Column:
    joined = F.array_join(F.transform(c, lambda x: _text(x, real)), ",")
    return F.when(c.isNull() | (F.size(c) <= 0), ".").otherwise(joined)


class Projection:
    """Compiles one format for a schema. ``undefined``: undefined tags are ``.`` instead of an error."""

    def __init__(self, fmt: str, schema: VariantSchema, undefined: bool = False) -> None:
        self.schema, self.undefined = schema, undefined
        if "\\n" not in fmt and "\n" not in fmt:
            fmt += "\\n"
        self.parts: list[tuple[str, object]] = []
        inside: list | None = None
        for m in _PART.finditer(fmt):
            if m["open"]:
                inside = []
            elif m["close"]:
                self.parts.append(("samples", inside))
                inside = None
            else:
                part = ("text", {"n": "\n", "t": "\t", "\\": "\\"}[m["esc"]]) if m["esc"] else ("text", m["text"]) if m["text"] else ("fn", (m["fn"], m["arg"])) if m["fn"] else ("tag", (m["tag"], m["i"]))
                (self.parts if inside is None else inside).append(part)

    def column(self) -> Column:
        return F.concat(*[F.concat(F.lit(""), self._samples(p[1])) if p[0] == "samples" else self._site(p) for p in self.parts])

    def _samples(self, parts: list) -> Column:
        names = F.array(*[F.lit(n) for n in self.schema.samples]) if self.schema.samples else None

        def one(s: Column, i: Column) -> Column:
            return F.concat(F.lit(""), *[self._sample(p, s, i, names) for p in parts])

        return F.array_join(F.transform("samples", one), "")

    def _site(self, part: tuple) -> Column:
        kind, v = part
        if kind == "text":
            return F.lit(v)
        if kind == "fn":
            name, arg = v
            if name == "N_PASS":
                return F.size(F.filter(compile_filter(arg, self.schema).sample_mask(F.size("samples")), lambda x: x)).cast("string")
            return _number(compile_value(f"{name}({arg})", self.schema).col)
        tag, i = v
        maker = _FIXED.get(tag)
        if maker:
            return maker(i)
        name = tag.removeprefix("INFO/")
        if name in self.schema.info:
            return self._value(F.col("info")[name], self.schema.info[name], i)
        if tag == "INFO":
            return info_text(self.schema)
        if tag == "FORMAT":
            return F.lit(":".join(self.schema.format))
        if tag == "LINE":
            return record_text(self.schema, bool(self.schema.info), bool(self.schema.format))
        if self.undefined:
            return F.lit(".")
        try:
            return _number(compile_value(tag, self.schema).col)
        except ValueError:
            raise ValueError(f"no tag {tag}") from None

    @staticmethod
    def _value(c: Column, tag: Tag, i: str | None) -> Column:
        real = tag.type == "Float"
        return (_text(F.get(c, F.lit(int(i))), real) if i is not None else _list(c, real)) if tag.is_vector else _text(c, real)

    def _sample(self, part: tuple, s: Column, i: Column, names: Column | None) -> Column:
        kind, v = part
        if kind == "fn" and v[0] == "PBINOM":
            return F.get(F.col("_pbinom_" + v[1].split("/")[-1]), i)
        if kind != "tag":
            return self._site(part)
        tag, at = v
        tag = tag.removeprefix("FORMAT/").removeprefix("FMT/")
        if tag == "SAMPLE":
            return F.get(names, i) if names is not None else i.cast("string")
        if tag == "GT":
            return g.gt_text(s["GT"])
        if tag == "TGT":
            return g.translated(s["GT"], F.col("ref"), F.col("alts"))
        if tag == "IUPACGT":
            return F.when(g.is_missing(s["GT"]), "./.").otherwise(al.iupac(F.col("ref"), F.col("alts"), s["GT"]["alleles"]))
        if tag in self.schema.format:
            return self._value(s[tag], self.schema.format[tag], at)
        if tag == "FORMAT":
            return sample_text(self.schema, s)
        return self._site(part)


def _number(c: Column) -> Column:
    return _text(c, True)


_FIXED: dict[str, Callable[[str | None], Column]] = {
    "CHROM": lambda _: F.col("chrom"), "POS": lambda _: F.col("pos").cast("string"), "POS0": lambda _: (F.col("pos") - 1).cast("string"), "END": lambda _: F.col("end").cast("string"), "END0": lambda _: (F.col("end") - 1).cast("string"),
    "ID": lambda _: _text(F.col("id")), "REF": lambda _: F.col("ref"), "ALT": lambda i: _list(F.col("alts")) if i is None else _text(F.get("alts", F.lit(int(i)))), "FIRST_ALT": lambda _: _text(F.get("alts", F.lit(0))),
    "QUAL": lambda _: _text(F.col("qual"), True), "FILTER": lambda _: F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise("."), "TYPE": lambda _: F.upper(F.array_join(al.variant_types(F.col("ref"), F.col("alts")), ",")),
    "IS_TS": lambda _: al.is_transition(F.col("ref"), F.get("alts", F.lit(0))).cast("int").cast("string"), "_CHROM_POS_ID": lambda _: F.coalesce("id", F.concat("chrom", F.lit(":"), F.col("pos").cast("string"))),
}


def project(df: DataFrame, fmt: str, samples: list[str] | None = None, where: str | None = None, undefined: bool = False) -> DataFrame:
    """A row of text for each site (that ``where`` keeps)."""
    schema = schema_of(df, samples)
    if where:
        df = df.where(compile_filter(where, schema).site)
    for tag in set(re.findall(r"%PBINOM\(([\w/]+)\)", fmt)):
        df = df.withColumn("_pbinom_" + tag.split("/")[-1], _phred_of_balance(tag.split("/")[-1]))
    return df.select("chrom", "pos", Projection(fmt, schema, undefined).column().alias("line"))


def _phred_of_balance(tag: str) -> Column:
    """Per sample: the phred score of the binomial test of the two alleles' values; 0 if they are equal, ``.`` if there are none."""
    of = lambda k: F.transform("samples", lambda s: F.when(~g.is_missing(s["GT"]) & (g.ploidy(s["GT"]) == 2), F.get(s[tag], F.get(s["GT"]["alleles"], F.lit(k)))).cast("double"))
    known = F.zip_with(of(0), of(1), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    score = lambda v, p: F.when(v["x"].isNull() | v["y"].isNull() | ((v["x"] == 0) & (v["y"] == 0)), ".").when((v["x"] == v["y"]) | (p >= 1), "0").otherwise(general(-10 * F.log10(p)))
    return F.zip_with(known, binom_arrays_udf(of(0), of(1)), score)


def header(fmt: str) -> str:
    """The columns' names, for a header line."""
    return "#" + re.sub(r"%(?:INFO/|FORMAT/|FMT/)?(\w+)(?:\{\d+\})?", r"\1", fmt).replace("\\t", "\t").replace("\\n", "\n")
