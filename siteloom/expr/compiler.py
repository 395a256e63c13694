"""From the tree of an expression to a pair of columns: ``site`` (boolean) and ``samples`` (array<boolean>, or none).

Missing values don't follow SQL's three-valued logic: ``==`` holds if both sides are missing, ``!=`` if exactly one is, and
``< <= > >=`` never hold for a missing side. A comparison of vectors holds if any pair of elements satisfies it. Numbers
are compared as 32-bit floats unless one is beyond 2**24.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.expr.parser import FilterSyntaxError, Node, parse
from siteloom.functions import alleles as al
from siteloom.functions import genotype as g
from siteloom.functions.stats import binom_arrays_udf, binom_udf, fisher_arrays_udf, fisher_udf
from siteloom.schema import VariantSchema, schema_of

COMPARISONS = ("==", "=", "!=", "<", "<=", ">", ">=", "~", "!~")
FIXED = ("QUAL", "TYPE", "FILTER", "ID", "CHROM", "POS", "REF", "ALT")


@dataclass
class Value:
    """A sub-expression's value.

    ``level``: site or sample (then ``col`` is an array over samples); ``vector``: each value is an array; ``kind``:
    num, str, or one of the special filter, type, id, gt.
    """

    col: Column
    level: str = "site"
    vector: bool = False
    kind: str = "num"
    text: str = ""


@dataclass
class Compiled:
    """A predicate. ``samples`` is None where the expression has no sample level."""

    site: Column
    samples: Column | None = None

    def sample_mask(self, n_samples: Column) -> Column:
        """The mask over samples; that of the site for all where the expression has none."""
        if self.samples is not None:
            return self.samples
        return F.transform(F.sequence(F.lit(1), n_samples), lambda _: self.site)


def ieee_divide(a: Column, b: Column) -> Column:
    """Division as of doubles: infinities and NaN instead of errors; null stays null."""
    a, b = a.cast("double"), b.cast("double")
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b != 0, F.try_divide(a, b)).when(a.isNull() | b.isNull(), None).when(a > 0, inf).when(a < 0, -inf).otherwise(nan)


def bre_to_java(pattern: str) -> str:
    """POSIX basic to Java: ``+ ? | ( ) { }`` are letters unless escaped."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            out.append(n if n in "+?|(){}" else c + n)
            i += 2
            continue
        if c == "[":
            end = pattern.find("]", i + 2)
            if end > 0:
                out.append(pattern[i : end + 1])
                i = end + 1
                continue
        out.append("\\" + c if c in "+?|(){}" else c)
        i += 1
    return "".join(out)


def _as_float(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    big = (F.abs(a) > 16777216) | (F.abs(b) > 16777216)
    return F.when(big, f(a, b)).otherwise(f(a.cast("float"), b.cast("float")))


def _compare(op: str, kind: str) -> Callable[[Column, Column], Column]:
    plain: dict[str, Callable] = {
        "==": lambda a, b: a.eqNullSafe(b), "=": lambda a, b: a.eqNullSafe(b), "!=": lambda a, b: ~a.eqNullSafe(b),
        "<": lambda a, b: F.coalesce(a < b, F.lit(False)), "<=": lambda a, b: F.coalesce(a <= b, F.lit(False)),
        ">": lambda a, b: F.coalesce(a > b, F.lit(False)), ">=": lambda a, b: F.coalesce(a >= b, F.lit(False)),
    }
    f = plain[op]
    return (lambda a, b: F.coalesce(_as_float(a, b, f), f(a, b))) if kind == "num" else f


def _or_missing(col: Column) -> Column:
    """A vector; an empty one, or none, is one missing element."""
    return F.when(col.isNull() | (F.size(col) <= 0), F.array(F.get(col, F.lit(0)))).otherwise(col)


def _any_pair(a: Column, va: bool, b: Column, vb: bool, f: Callable[[Column, Column], Column]) -> Column:
    if va and vb:
        return F.exists(_or_missing(a), lambda x: F.exists(_or_missing(b), lambda y: f(x, y)))
    if va:
        return F.exists(_or_missing(a), lambda x: f(x, b))
    if vb:
        return F.exists(_or_missing(b), lambda y: f(a, y))
    return f(a, b)


def _any(mask: Column) -> Column:
    return F.coalesce(F.exists(mask, lambda x: x), F.lit(False))


class Compiler:
    """Compiles against one schema. ``files`` resolves ``@name`` to a list of strings; ``params`` fills ``{}`` values."""

    def __init__(self, schema: VariantSchema, files: dict[str, list[str]] | None = None, params: dict[str, object] | None = None, udfs: dict[str, Callable] | None = None) -> None:
        self.schema, self.files, self.params, self.udfs = schema, files or {}, params or {}, udfs or {}

    # --- predicates
    def predicate(self, node: Node) -> Compiled:
        if node.kind == "op" and node.value in ("&&", "&", "||", "|"):
            return self._logic(node.value, self.predicate(node.args[0]), self.predicate(node.args[1]))
        if node.kind == "op" and node.value in COMPARISONS:
            return self._comparison(node)
        v = self.value(node)
        # a bare value holds if it is there and not zero
        truth = (lambda x: F.coalesce(x != 0, F.lit(False))) if v.kind == "num" else (lambda x: x.isNotNull())
        if v.level == "site":
            return Compiled(F.exists(v.col, truth) if v.vector else truth(v.col))
        mask = F.transform(v.col, (lambda s: F.coalesce(F.exists(s, truth), F.lit(False))) if v.vector else truth)
        return Compiled(_any(mask), mask)

    def _logic(self, op: str, a: Compiled, b: Compiled) -> Compiled:
        both = a.samples is not None and b.samples is not None
        one = a.samples if a.samples is not None else b.samples
        if op in ("&&", "&"):
            site = a.site & b.site
            if one is None:
                return Compiled(site)
            if not both:
                return Compiled(site, F.transform(one, lambda x: x & site) if op == "&&" else one)
            if op == "&&":
                mask = F.zip_with(a.samples, b.samples, lambda x, y: (x | y) & site)
                return Compiled(site, mask)
            mask = F.zip_with(a.samples, b.samples, lambda x, y: x & y)
            return Compiled(site & _any(mask), mask)
        site = a.site | b.site
        if one is None:
            return Compiled(site)
        if op == "|":
            return Compiled(site, F.zip_with(a.samples, b.samples, lambda x, y: x | y) if both else one)
        if both:
            return Compiled(site, F.transform(one, lambda _: site))
        plain = a.site if a.samples is None else b.site
        return Compiled(site, F.when(plain, F.transform(one, lambda _: F.lit(True))).otherwise(one))

    def _comparison(self, node: Node) -> Compiled:
        op = node.value
        left, right = node.args
        for x, y, flip in ((left, right, False), (right, left, True)):
            special = self._special(x, y, op, flip)
            if special is not None:
                return special
        a, b = self.value(left), self.value(right)
        # "." is the missing number
        if a.kind == "num" and right.kind == "string" and _unquote(right.value)[0] == ".":
            b = Value(F.lit(None).cast("double"))
        if b.kind == "num" and left.kind == "string" and _unquote(left.value)[0] == ".":
            a = Value(F.lit(None).cast("double"))
        kind = "str" if "str" in (a.kind, b.kind) else "num"
        if op in ("~", "!~"):
            return self._regex(a, right, op)
        if right.kind == "file" or left.kind == "file":
            f = lambda x, y: F.coalesce(F.array_contains(y, x), F.lit(False))
            inside, values = (a, b) if right.kind == "file" else (b, a)
            test = (lambda x: f(x, values.col)) if op in ("==", "=") else (lambda x: ~f(x, values.col))
            return self._each(inside, test)
        if kind == "str":
            a, b = (Value(v.col.cast("string") if not v.vector and v.level == "site" else v.col, v.level, v.vector, "str") for v in (a, b))
        f = _compare(op, kind)
        if a.level == "site" and b.level == "site":
            return Compiled(_any_pair(a.col, a.vector, b.col, b.vector, f))
        if a.level == "sample" and b.level == "sample":
            if a.vector and b.vector:  # element by element
                mask = F.zip_with(a.col, b.col, lambda x, y: F.exists(F.zip_with(_or_missing(x), _or_missing(y), f), lambda z: z))
            else:
                mask = F.zip_with(a.col, b.col, lambda x, y: _any_pair(x, a.vector, y, b.vector, f))
        elif a.level == "sample":
            mask = F.transform(a.col, lambda x: _any_pair(x, a.vector, b.col, b.vector, f))
        else:
            mask = F.transform(b.col, lambda y: _any_pair(a.col, a.vector, y, b.vector, f))
        mask = F.transform(mask, lambda x: F.coalesce(x, F.lit(False)))
        return Compiled(_any(mask), mask)

    def _each(self, v: Value, test: Callable[[Column], Column]) -> Compiled:
        if v.level == "site":
            return Compiled(F.exists(_or_missing(v.col), test) if v.vector else test(v.col))
        mask = F.transform(v.col, (lambda s: F.exists(_or_missing(s), test)) if v.vector else test)
        return Compiled(_any(mask), mask)

    def _regex(self, a: Value, right: Node, op: str) -> Compiled:
        if right.kind != "string":
            raise FilterSyntaxError("a regular expression has to be a string")
        body, ignore = _unquote(right.value)
        pattern = ("(?i)" if ignore else "") + bre_to_java(body)

        def test(x: Column) -> Column:
            parts = F.split(x.cast("string"), ",")
            hit = F.coalesce(F.exists(parts, lambda p: p.rlike(pattern)), F.lit(False))
            return hit if op == "~" else ~hit

        return self._each(a, test)

    def _special(self, x: Node, y: Node, op: str, flip: bool) -> Compiled | None:
        """FILTER, TYPE, ID and GT compare by rules of their own."""
        if x.kind != "name" or y.kind not in ("string", "file", "name", "number"):
            return None
        name, index = x.value, x.index
        scope, _, tag = name.rpartition("/")
        if tag == "GT" and scope in ("", "FORMAT", "FMT") and y.kind == "string" and op in ("==", "=", "!=", "~", "!~"):
            return self._genotype(y, op, index)
        if scope:
            return None
        fixed = self._fixed(name)
        if fixed == "FILTER" and y.kind == "string":
            wanted = [w for w in _unquote(y.value)[0].split(";") if w and w != "."]
            have = F.coalesce(F.col("filters"), F.array().cast("array<string>"))
            want = F.array(*[F.lit(w) for w in wanted]).cast("array<string>")
            same = (F.size(F.array_except(want, have)) == 0) & (F.size(F.array_except(have, want)) == 0)
            inside = (F.size(F.array_except(want, have)) == 0) & (F.size(want) > 0)
            if not wanted:
                same = inside = F.size(have) == 0
            return Compiled({"==": same, "=": same, "!=": ~same, "~": inside, "!~": ~inside}[op])
        if fixed == "TYPE" and y.kind == "string":
            mask = 0
            for t in _unquote(y.value)[0].lower().split(","):
                t = {"indels": "indel", "snps": "snp", "mnps": "mnp"}.get(t, t)
                if t not in al.TYPE_BITS:
                    raise FilterSyntaxError(f"no variant type {t!r}")
                mask |= al.TYPE_BITS[t]
            have = al.type_mask(F.col("ref"), F.col("alts"))
            some = have.bitwiseAND(mask) != 0 if mask else have == 0
            return Compiled({"==": have == mask, "=": have == mask, "!=": have != mask, "~": some, "!~": ~some}[op])
        if fixed == "ID":
            ids = F.split(F.coalesce(F.col("id"), F.lit(".")), ";")
            if y.kind == "file":
                hit = F.arrays_overlap(ids, self._file(y.value))
            elif y.kind == "string" and op in ("==", "=", "!="):
                hit = F.array_contains(ids, _unquote(y.value)[0])
            else:
                return None
            return Compiled(~hit if op == "!=" else hit)
        return None

    def _genotype(self, y: Node, op: str, index: str | None) -> Compiled:
        body, ignore = _unquote(y.value)
        if op in ("~", "!~"):
            pattern = ("(?i)" if ignore else "") + bre_to_java(body)
            test = lambda s: g.gt_text(s["GT"]).rlike(pattern)
        elif body in g.CLASSES or body.lower() in ("ref", "alt", "mis", "hom", "het", "hap"):
            test = lambda s: g.genotype_class(s["GT"], body)
        else:
            test = lambda s: g.gt_text(s["GT"]) == body
        mask = F.transform(self._picked(F.col("samples"), index), (lambda s: ~test(s)) if op in ("!=", "!~") else test)
        return Compiled(_any(mask), mask)

    def _file(self, name: str) -> Column:
        return F.array(*[F.lit(v) for v in self.files[name.lstrip("@")]]).cast("array<string>")

    # --- values
    def _fixed(self, name: str) -> str | None:
        """Any abbreviation of a fixed column's name means the column, in any case."""
        if name.upper() in ("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "TYPE"):
            return name.upper()
        if name in self.schema.info or name in self.schema.format:
            return None
        return next((f for f in FIXED if f.startswith(name.upper())), None)

    def value(self, node: Node) -> Value:
        if node.kind == "number":
            return Value(F.lit(float(node.value)))
        if node.kind == "string":
            return Value(F.lit(_unquote(node.value)[0]), kind="str", text=node.value)
        if node.kind == "file":
            return Value(self._file(node.value), kind="str")
        if node.kind == "param":
            key = node.value.strip("{}")
            v = self.params[key]
            if isinstance(v, Column):
                return Value(v, kind="num")
            return Value(F.lit(v), kind="str" if isinstance(v, str) else "num")
        if node.kind == "name":
            return self._name(node)
        if node.kind == "call":
            return self._call(node)
        if node.value in ("+", "-", "*", "/", "%"):
            return self._arithmetic(node.value, self.value(node.args[0]), self.value(node.args[1]))
        # a predicate as a value: its sample mask as numbers
        p = self.predicate(node)
        if p.samples is None:
            return Value(p.site.cast("double"))
        return Value(F.transform(p.samples, lambda x: F.when(x, F.lit(1.0))), "sample")

    def _arithmetic(self, op: str, a: Value, b: Value) -> Value:
        fs: dict[str, Callable] = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y, "/": ieee_divide, "%": lambda x, y: F.try_mod(x.cast("int"), y.cast("int")).cast("double")}
        f = fs[op]

        def pair(x: Column, vx: bool, y: Column, vy: bool) -> Column:
            if vx and vy:
                return F.zip_with(x, y, f)
            if vx:
                return F.transform(x, lambda e: f(e, y))
            if vy:
                return F.transform(y, lambda e: f(x, e))
            return f(x, y)

        vector = a.vector or b.vector
        if a.level == "site" and b.level == "site":
            return Value(pair(a.col, a.vector, b.col, b.vector), vector=vector)
        if a.level == b.level:
            return Value(F.zip_with(a.col, b.col, lambda x, y: pair(x, a.vector, y, b.vector)), "sample", vector)
        if a.level == "sample":
            return Value(F.transform(a.col, lambda x: pair(x, a.vector, b.col, b.vector)), "sample", vector)
        return Value(F.transform(b.col, lambda y: pair(a.col, a.vector, y, b.vector)), "sample", vector)

    def _name(self, node: Node) -> Value:
        name, index = node.value, node.index
        scope, _, tag = name.rpartition("/")
        scope = {"FMT": "FORMAT"}.get(scope, scope)
        if not scope and name not in ("N_ALT", "N_SAMPLES") and (fixed := self._fixed(name)):
            return self._indexed(self._fixed_value(fixed), index)
        in_info, in_format = tag in self.schema.info, tag in self.schema.format
        if not scope and in_info and in_format:
            raise FilterSyntaxError(f"{tag} is both an INFO and a FORMAT tag: say INFO/{tag} or FORMAT/{tag}")
        if scope == "INFO" or (not scope and in_info):
            if not in_info:
                raise FilterSyntaxError(f"no INFO tag {tag}")
            t = self.schema.info[tag]
            col = F.col("info")[tag]
            if t.type == "Flag":
                return Value(F.coalesce(col.cast("double"), F.lit(0.0)))
            kind = "str" if t.type in ("String", "Character") else "num"
            col = self._numbers(col, t.is_vector) if kind == "num" else col
            return self._indexed(Value(col, vector=t.is_vector, kind=kind), index)
        if scope == "FORMAT" or (not scope and in_format):
            if not in_format:
                raise FilterSyntaxError(f"no FORMAT tag {tag}")
            return self._format(tag, index)
        computed = self._computed(tag)
        if computed is None:
            raise FilterSyntaxError(f"no tag {name}")
        return self._indexed(computed, index)

    @staticmethod
    def _numbers(col: Column, vector: bool) -> Column:
        return F.transform(col, lambda x: x.cast("double")) if vector else col.cast("double")

    def _fixed_value(self, name: str) -> Value:
        if name == "ALT":
            return Value(F.col("alts"), vector=True, kind="str")
        if name == "FILTER":
            return Value(F.col("filters"), vector=True, kind="str")
        if name == "TYPE":
            return Value(al.variant_types(F.col("ref"), F.col("alts")), vector=True, kind="str")
        if name in ("QUAL", "POS"):
            return Value(F.col(name.lower()).cast("double"))
        return Value(F.col(name.lower()), kind="str")

    def _computed(self, name: str) -> Value | None:
        samples, alts = F.col("samples"), F.col("alts")
        n_samples = F.size(samples)
        ac = lambda: self._numbers(g.allele_counts(samples, alts), True)
        an = lambda: g.allele_number(samples).cast("double")
        missing = lambda: F.size(F.filter(samples, lambda s: g.is_missing(s["GT"]))).cast("double")
        makers: dict[str, Callable[[], Value]] = {
            "N_ALT": lambda: Value(F.size(F.coalesce(alts, F.array().cast("array<string>"))).cast("double")),
            "N_SAMPLES": lambda: Value(n_samples.cast("double")),
            "AC": lambda: Value(ac(), vector=True),
            "AN": lambda: Value(an()),
            "MAC": lambda: Value(F.transform(ac(), lambda c: F.when(c > an() / 2, an() - c).otherwise(c)), vector=True),
            "AF": lambda: Value(F.transform(ac(), lambda c: ieee_divide(c, an())), vector=True),
            "MAF": lambda: Value(F.transform(ac(), lambda c: F.least(ieee_divide(c, an()), 1 - ieee_divide(c, an()))), vector=True),
            "N_MISSING": lambda: Value(missing()),
            "F_MISSING": lambda: Value(ieee_divide(missing(), n_samples)),
            "ILEN": lambda: Value(self._numbers(al.indel_length(F.col("ref"), alts), True), vector=True),
        }
        return makers[name]() if name in makers else None

    # --- subscripts
    @staticmethod
    def _index_test(spec: str) -> Callable[[Column], Column]:
        """A test of a place (from 0): ``i``, ``i,j``, ``i-j``, ``i-``, ``*``."""
        spec = spec.strip()
        if spec in ("", "*"):
            return lambda i: F.lit(True)
        tests: list[Callable[[Column], Column]] = []
        for part in spec.split(","):
            m = re.fullmatch(r"\s*(\d+)\s*(-)?\s*(\d+)?\s*", part)
            if not m:
                raise FilterSyntaxError(f"no such subscript: [{spec}]")
            lo = int(m[1])
            if not m[2]:
                tests.append(lambda i, lo=lo: i == lo)
            elif m[3]:
                tests.append(lambda i, lo=lo, hi=int(m[3]): (i >= lo) & (i <= hi))
            else:
                tests.append(lambda i, lo=lo: i >= lo)

        def test(i: Column) -> Column:
            out = tests[0](i)
            for t in tests[1:]:
                out = out | t(i)
            return out

        return test

    def _elements(self, col: Column, spec: str) -> Column:
        test = self._index_test(spec)
        return F.filter(col, lambda _, i: test(i))

    def _indexed(self, v: Value, index: str | None) -> Value:
        if index is None or not v.vector:
            return v
        if index.isdigit():
            return Value(F.get(v.col, F.lit(int(index))), v.level, False, v.kind)
        return Value(self._elements(v.col, index), v.level, True, v.kind)

    def _picked(self, samples: Column, index: str | None) -> Column:
        """The samples that a subscript's first part names: places, or ``@file`` of names."""
        if not index or index in ("*",):
            return samples
        if index.startswith("@"):
            names = set(self.files[index[1:]])
            index = ",".join(str(i) for i, n in enumerate(self.schema.samples) if n in names)
        return self._elements(samples, index)

    def _format(self, tag: str, index: str | None) -> Value:
        t = self.schema.format[tag]
        kind = "str" if tag == "GT" or t.type in ("String", "Character") else "num"
        who, _, what = index.rpartition(":") if index and ":" in index else ("", "", index or "")
        if index and ":" not in index and not t.is_vector:
            who, what = index, ""
        samples = self._picked(F.col("samples"), who)
        if tag == "GT":
            return Value(F.transform(samples, lambda s: g.gt_text(s["GT"])), "sample", False, "str")
        one = (lambda s: self._numbers(s[tag], t.is_vector)) if kind == "num" else (lambda s: s[tag])
        if what == "GT":
            picked = lambda s: F.filter(one(s), lambda _, i: F.array_contains(F.filter(s["GT"]["alleles"], lambda a: a.isNotNull()), i))
            return Value(F.transform(samples, picked), "sample", True, kind)
        if t.is_vector and what.isdigit():
            return Value(F.transform(samples, lambda s: F.get(one(s), F.lit(int(what)))), "sample", False, kind)
        if t.is_vector and what not in ("", "*"):
            return Value(F.transform(samples, lambda s: self._elements(one(s), what)), "sample", True, kind)
        return Value(F.transform(samples, one), "sample", t.is_vector, kind)

    # --- functions
    def _call(self, node: Node) -> Value:
        name = node.value
        up = name.upper()
        if name in self.udfs:
            return Value(self.udfs[name](*[self.value(a).col for a in node.args]))
        if up in ("N_PASS", "F_PASS"):
            p = self.predicate(node.args[0])
            mask = p.sample_mask(F.size("samples"))
            n = F.size(F.filter(mask, lambda x: x)).cast("double")
            return Value(n if up == "N_PASS" else ieee_divide(n, F.size(mask)))
        if up in ("BINOM", "FISHER"):
            return self._test(up, node)
        if up == "PHRED":
            return self._elementwise(self.value(node.args[0]), lambda x: F.when(x == 0, F.lit(float("inf"))).otherwise(-10 * F.log10(x)))
        if up == "ABS":
            return self._elementwise(self.value(node.args[0]), F.abs)
        if up == "STRLEN":
            return self._elementwise(self.value(node.args[0]), lambda x: F.length(x).cast("double"))
        base = {"MEAN": "AVG"}.get(up, up)
        per_sample = False
        for prefix in ("SMPL_", "S"):
            if base.startswith(prefix) and base[len(prefix) :] in (*_SUMMARIES, "MEAN", "COUNT") and base not in _SUMMARIES:
                base, per_sample = base[len(prefix) :], True
                break
        base = {"MEAN": "AVG"}.get(base, base)
        if base not in _SUMMARIES and base != "COUNT":
            raise FilterSyntaxError(f"no function {name}")
        v = self.value(node.args[0])
        if per_sample:
            if v.level != "sample":
                raise FilterSyntaxError(f"{name} needs a FORMAT tag")
            each = (lambda s: s) if v.vector else (lambda s: F.array(s))
            return Value(F.transform(v.col, lambda s: _summary(base, each(s))), "sample")
        flat = v.col if v.vector or v.level == "sample" else F.array(v.col)
        if v.level == "sample" and v.vector:
            flat = F.flatten(F.transform(v.col, lambda s: F.coalesce(s, F.array().cast("array<string>" if v.kind == "str" else "array<double>"))))
        return Value(_summary(base, flat))

    @staticmethod
    def _elementwise(v: Value, f: Callable[[Column], Column]) -> Value:
        if v.level == "site":
            return Value(F.transform(v.col, f) if v.vector else f(v.col), "site", v.vector)
        return Value(F.transform(v.col, (lambda s: F.transform(s, f)) if v.vector else f), "sample", v.vector)

    def _test(self, name: str, node: Node) -> Value:
        """Exact tests: of site-level values, or of each sample's.

        Of one sample-level tag for BINOM, or two for FISHER, the two values of the genotype's alleles are taken.
        """
        args = [self.value(a) for a in node.args]
        if args[0].level != "sample":
            at = lambda v, i: F.get(v.col, F.lit(i)) if v.vector else v.col
            if name == "BINOM":
                a, b = (at(args[0], 0), at(args[0], 1)) if len(args) == 1 else (at(args[0], 0), at(args[1], 0))
                return Value(binom_udf(a, b))
            return Value(fisher_udf(*[at(args[0], i) for i in range(4)] if len(args) == 1 else [at(args[0], 0), at(args[0], 1), at(args[1], 0), at(args[1], 1)]))

        def of_sample(v: Value, i: int) -> Column:
            return F.transform(v.col, lambda s: (F.get(s, F.lit(i)) if v.vector else s).cast("double"))

        def of_allele(v: Value, k: int) -> Column:
            """Of the k-th allele of diploid genotypes without a missing one; others have none."""
            allele = F.transform("samples", lambda s: F.when(~g.is_missing(s["GT"]) & (g.ploidy(s["GT"]) >= 2), F.get(s["GT"]["alleles"], F.lit(k))))
            return F.zip_with(v.col, allele, lambda s, a: F.get(s, a).cast("double"))

        if name == "BINOM":
            pair = [of_allele(args[0], 0), of_allele(args[0], 1)] if len(args) == 1 else [of_sample(args[0], 0), of_sample(args[1], 0)]
            return Value(binom_arrays_udf(*pair), "sample")
        if len(args) == 1:
            return Value(fisher_arrays_udf(*[of_sample(args[0], i) for i in range(4)]), "sample")
        pick = of_sample if any(a.index is not None for a in node.args) else of_allele
        return Value(fisher_arrays_udf(pick(args[0], 0), pick(args[0], 1), pick(args[1], 0), pick(args[1], 1)), "sample")


_SUMMARIES = ("MAX", "MIN", "AVG", "MEDIAN", "STDEV", "SUM")


def _summary(name: str, values: Column) -> Column:
    """Of the elements that aren't missing; null of none."""
    x = F.filter(values, lambda e: e.isNotNull())
    if name == "COUNT":
        return F.size(x).cast("double")
    n = F.size(x)
    total = F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e)
    if name == "MAX":
        out = F.array_max(x)
    elif name == "MIN":
        out = F.array_min(x)
    elif name == "SUM":
        out = total
    elif name == "AVG":
        out = total / n
    elif name == "MEDIAN":
        s = F.array_sort(x)
        out = (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2
    else:
        mean = total / n
        out = F.sqrt(F.aggregate(x, F.lit(0.0), lambda acc, e: acc + (e - mean) * (e - mean)) / n)
    return F.when(n > 0, out)


def _unquote(text: str) -> tuple[str, bool]:
    ignore = text.endswith("/i") and len(text) > 3 and text[-3] in "\"'"
    body = text[:-2] if ignore else text
    return body[1:-1], ignore


def compile_filter(text: str, table: DataFrame | VariantSchema, files: dict[str, list[str]] | None = None, params: dict[str, object] | None = None, right: bool = True, udfs: dict[str, Callable] | None = None) -> Compiled:
    """The predicate of an expression for a variant table or its schema."""
    schema = table if isinstance(table, VariantSchema) else schema_of(table)
    return Compiler(schema, files, params, udfs).predicate(parse(text, right))


def compile_value(text: str, table: DataFrame | VariantSchema, **kw) -> Value:
    """The value of an expression, for output and for new tags."""
    schema = table if isinstance(table, VariantSchema) else schema_of(table)
    return Compiler(schema, kw.get("files"), kw.get("params"), kw.get("udfs")).value(parse(text, kw.get("right", True)))


__all__ = ["Compiled", "Compiler", "Value", "compile_filter", "compile_value"]
