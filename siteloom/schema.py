"""The canonical layout of a variant table, and what is known of its tags.

A site row has ``chrom, contig_idx, pos (1-based), end, id, ref, alts, qual, filters, info struct, samples array<struct>``.
``samples`` is aligned with the order of sample names. Genotypes are ``struct<alleles: array<int>, phased: boolean>``;
a null allele is a missing one.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

GT = T.StructType([T.StructField("alleles", T.ArrayType(T.IntegerType())), T.StructField("phased", T.BooleanType())])
_TYPES = {"Integer": T.IntegerType(), "Float": T.FloatType(), "String": T.StringType(), "Character": T.StringType()}


@dataclass(frozen=True)
class Tag:
    """One INFO or FORMAT tag. ``number``: a count, or A (per ALT), R (per allele), G (per genotype), ``.`` (any)."""

    id: str
    number: str = "1"
    type: str = "Integer"
    description: str = ""

    @property
    def is_vector(self) -> bool:
        return self.number not in ("0", "1")

    @property
    def spark_type(self) -> T.DataType:
        if self.type == "Flag":
            return T.BooleanType()
        base = _TYPES[self.type]
        return T.ArrayType(base) if self.is_vector else base


@dataclass
class VariantSchema:
    """Tags, contigs, filters and samples of a variant table."""

    info: dict[str, Tag] = field(default_factory=dict)
    format: dict[str, Tag] = field(default_factory=dict)
    contigs: dict[str, int | None] = field(default_factory=dict)  # name -> length, in header order
    filters: dict[str, str] = field(default_factory=dict)
    samples: list[str] = field(default_factory=list)

    def info_type(self) -> T.StructType:
        return T.StructType([T.StructField(t.id, t.spark_type, True, {"number": t.number, "type": t.type, "description": t.description}) for t in self.info.values()])

    def sample_type(self) -> T.StructType:
        return T.StructType([T.StructField(t.id, GT if t.id == "GT" else t.spark_type, True, {"number": t.number, "type": t.type}) for t in self.format.values()])

    def table_type(self) -> T.StructType:
        return T.StructType([
            T.StructField("chrom", T.StringType()), T.StructField("contig_idx", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("end", T.LongType()), T.StructField("id", T.StringType()),
            T.StructField("ref", T.StringType()), T.StructField("alts", T.ArrayType(T.StringType())), T.StructField("qual", T.FloatType()), T.StructField("filters", T.ArrayType(T.StringType())),
            T.StructField("info", self.info_type()), T.StructField("samples", T.ArrayType(self.sample_type())),
        ])


def schema_of(df: DataFrame, samples: list[str] | None = None) -> VariantSchema:
    """A schema guessed from the columns of a variant table; field metadata, where present, wins."""
    out = VariantSchema(samples=list(samples or []))

    def tag(f: T.StructField) -> Tag:
        meta = f.metadata or {}
        vector = isinstance(f.dataType, T.ArrayType)
        base = f.dataType.elementType if vector else f.dataType
        kind = "Flag" if isinstance(base, T.BooleanType) else "String" if isinstance(base, (T.StringType, T.StructType)) else "Float" if isinstance(base, (T.FloatType, T.DoubleType)) else "Integer"
        return Tag(f.name, meta.get("number", "." if vector else "0" if kind == "Flag" else "1"), meta.get("type", kind), meta.get("description", ""))

    kinds = {f.name: f.dataType for f in df.schema.fields}
    if isinstance(kinds.get("info"), T.StructType):
        out.info = {f.name: tag(f) for f in kinds["info"].fields}
    if isinstance(kinds.get("samples"), T.ArrayType):
        out.format = {f.name: tag(f) for f in kinds["samples"].elementType.fields}
    return out


def with_tag(df: DataFrame, name: str, value, scope: str = "info") -> DataFrame:
    """``df`` with one more (or a replaced) INFO tag."""
    if scope == "info":
        return df.withColumn("info", F.col("info").withField(name, value)) if "info" in df.columns else df.withColumn("info", F.struct(value.alias(name)))
    return df.withColumn("samples", F.transform("samples", lambda s: s.withField(name, value(s))))
