"""Variant text files as variant tables, and back. Parsing is done by column functions; only the header is read apart."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions.genotype import gt_text
from siteloom.functions.text import general
from siteloom.schema import Tag, VariantSchema

_META = re.compile(r"##(\w+)=<(.*)>$")
_FIELD = re.compile(r'(\w+)=("(?:[^"\\]|\\.)*"|[^,]*)')


def parse_header(lines: list[str]) -> VariantSchema:
    out = VariantSchema()
    for line in lines:
        if m := _META.match(line.strip()):
            f = {k: v.strip('"') for k, v in _FIELD.findall(m[2])}
            if m[1] == "contig":
                out.contigs[f["ID"]] = int(f["length"]) if f.get("length", "").isdigit() else None
            elif m[1] == "FILTER":
                out.filters[f["ID"]] = f.get("Description", "")
            elif m[1] in ("INFO", "FORMAT"):
                tag = Tag(f["ID"], f.get("Number", "."), f.get("Type", "String"), f.get("Description", ""))
                (out.info if m[1] == "INFO" else out.format)[tag.id] = tag
        elif line.startswith("#CHROM"):
            out.samples = line.rstrip("\n").split("\t")[9:]
    return out


def read_header(spark: SparkSession, path: str) -> VariantSchema:
    """The header's lines, which are few; the filter stops at none of the records' columns."""
    rows = spark.read.text(path).where(F.col("value").startswith("#")).collect()
    return parse_header([r[0] for r in rows])


def _number(c: Column, kind: str) -> Column:
    return F.expr("null").cast(kind) if c is None else F.when(c == ".", None).otherwise(c).try_cast(kind)


def _typed(c: Column, tag: Tag) -> Column:
    kind = {"Integer": "int", "Float": "float"}.get(tag.type, "string")
    if tag.type == "Flag":
        return c.isNotNull()
    if tag.is_vector:
        return F.when(c.isNotNull() & (c != "."), F.transform(F.split(c, ","), lambda x: _number(x, kind)))
    return _number(c, kind)


def _genotype(c: Column) -> Column:
    parts = F.transform(F.split(c, r"[/|]"), lambda x: _number(x, "int"))
    return F.struct(F.when(c.isNotNull(), parts).alias("alleles"), F.coalesce(F.contains(c, F.lit("|")), F.lit(False)).alias("phased"))


def read_vcf(spark: SparkSession, path: str, schema: VariantSchema | None = None) -> tuple[DataFrame, VariantSchema]:
    """A variant table and its schema. Undeclared contigs come after the declared ones."""
    schema = schema or read_header(spark, path)
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(f.alias("f"))
    col = lambda i: F.get("f", F.lit(i))
    dot = lambda c: F.when(c != ".", c)
    names = list(schema.contigs)
    order = F.array_position(F.array(*[F.lit(n) for n in names]), col(0)).cast("int") - 1 if names else F.lit(0)
    info_map = F.map_from_entries(F.transform(F.filter(F.split(col(7), ";"), lambda x: (x != ".") & (x != "")), lambda kv: F.struct(F.substring_index(kv, "=", 1), F.when(F.contains(kv, F.lit("=")), F.substr(kv, F.instr(kv, "=") + 1)).otherwise(F.lit("")))))
    rows = rows.withColumn("_info", info_map)
    info = F.struct(*[_typed(F.try_element_at("_info", F.lit(t.id)), t).alias(t.id) for t in schema.info.values()]) if schema.info else None
    out = rows.select(
        col(0).alias("chrom"), F.when(order < 0, len(names)).otherwise(order).alias("contig_idx"), col(1).cast("long").alias("pos"), dot(col(2)).alias("id"), F.upper(col(3)).alias("ref"),
        F.when(col(4) == ".", F.array().cast("array<string>")).otherwise(F.split(col(4), ",")).alias("alts"), _number(col(5), "float").alias("qual"),
        F.when(col(6) == ".", F.array().cast("array<string>")).otherwise(F.split(col(6), ";")).alias("filters"), *([info.alias("info")] if info is not None else []), "f", "_info",
    )
    end = F.coalesce(F.try_element_at("_info", F.lit("END")).try_cast("long"), F.col("pos") + F.length("ref") - 1)
    out = out.withColumn("end", end)
    if schema.samples and schema.format:
        keys = F.split(F.get("f", F.lit(8)), ":")
        out = out.withColumn("_keys", keys)

        def sample(text: Column) -> Column:
            parts = F.split(text, ":")
            value = lambda t: F.get(parts, F.array_position("_keys", t.id).cast("int") - 1)
            return F.struct(*[(_genotype(value(t)) if t.id == "GT" else _typed(value(t), t)).alias(t.id) for t in schema.format.values()])

        out = out.withColumn("samples", F.transform(F.slice("f", 10, len(schema.samples)), sample)).drop("_keys")
    return out.drop("f", "_info"), schema


def _out(c: Column, tag: Tag) -> Column:
    if tag.is_vector:
        return F.when(c.isNotNull() & (F.size(c) > 0), F.array_join(F.transform(c, lambda x: F.coalesce(_plain(x, tag), F.lit("."))), ","))
    return _plain(c, tag)


def _plain(c: Column, tag: Tag) -> Column:
    return general(c) if tag.type == "Float" else c.cast("string")


def info_text(schema: VariantSchema) -> Column:
    """``KEY=value;FLAG`` of the column ``info``; ``.`` without any."""
    parts = [F.when(F.coalesce(F.col("info")[t.id], F.lit(False)), F.lit(t.id)) if t.type == "Flag" else F.when(_out(F.col("info")[t.id], t).isNotNull(), F.concat(F.lit(f"{t.id}="), _out(F.col("info")[t.id], t))) for t in schema.info.values()]
    text = F.concat_ws(";", *parts) if parts else F.lit("")
    return F.when(text == "", ".").otherwise(text)


def sample_text(schema: VariantSchema, s: Column) -> Column:
    """The values of one sample, joined by colons."""
    return F.concat_ws(":", *[F.coalesce(gt_text(s["GT"]) if t.id == "GT" else _out(s[t.id], t), F.lit(".")) for t in schema.format.values()])


def record_text(schema: VariantSchema, has_info: bool = True, has_samples: bool = True) -> Column:
    """A site as a line of the text format."""
    dot = lambda c: F.coalesce(c, F.lit("."))
    cols = [F.col("chrom"), F.col("pos").cast("string"), dot(F.col("id")), F.col("ref"), F.when(F.size("alts") > 0, F.array_join("alts", ",")).otherwise("."), dot(general(F.col("qual"))), F.when(F.size("filters") > 0, F.array_join("filters", ";")).otherwise("."), info_text(schema) if has_info else F.lit(".")]
    if has_samples and schema.format:
        cols += [F.lit(":".join(schema.format)), F.array_join(F.transform("samples", lambda s: sample_text(schema, s)), "\t")]
    return F.concat_ws("\t", *cols)


def lines(df: DataFrame, schema: VariantSchema) -> DataFrame:
    """(contig_idx, pos, line): records as text."""
    return df.select("contig_idx", "pos", record_text(schema, "info" in df.columns, "samples" in df.columns).alias("line"))


def header_lines(schema: VariantSchema) -> list[str]:
    out = ["##fileformat=VCFv4.2"]
    out += [f'##FILTER=<ID={k},Description="{v}">' for k, v in schema.filters.items()]
    out += [f"##contig=<ID={k}" + (f",length={n}" if n else "") + ">" for k, n in schema.contigs.items()]
    for kind, tags in (("INFO", schema.info), ("FORMAT", schema.format)):
        out += [f'##{kind}=<ID={t.id},Number={t.number},Type={t.type},Description="{t.description}">' for t in tags.values()]
    return [*out, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *schema.samples] if schema.samples else [])])]


def write_vcf(df: DataFrame, schema: VariantSchema, path: str) -> None:
    """A folder of text parts in the order of sites; the first part holds the header only."""
    body = lines(df, schema).orderBy("contig_idx", "pos").select("line")
    spark = df.sparkSession
    spark.createDataFrame([("\n".join(header_lines(schema)),)], "line string").coalesce(1).write.text(f"{path}/header")
    body.write.text(f"{path}/records")
