"""Fill-in-the-middle: a text is cut at two unit borders into prefix, middle and suffix, and put together anew with marks.

Units are ``[A-Za-z]+|[^A-Za-z]``, matched left to right over code points, so they cover the whole text. The SHA-256 of
``seed:doc_id`` says where the two cuts are and which form a document takes: ``plain`` (the text as it is), ``psm``
(``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). So a row's
result depends on that row and the seed only: nothing is shuffled, and a lost task is run again with the same result.

A pandas UDF over Arrow batches does the work: a batch's bytes are bounded by ``spark.sql.execution.arrow.maxBytesPerBatch``
(a single text above it makes a batch of its own), and of a text's units only the end offsets are kept, 4 bytes each.

Defined results: a null text counts as empty, and an empty text is plain with no units; so is a text that contains a
mark, which therefore always can be restored. A null doc_id has no digits (``seed:``). Repeated rows give equal rows.
Other columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import table

UNIT = regex.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, so many are cut, and of a hundred cut ones, so many begin with the suffix.
CUT_PERCENT, SPM_PERCENT = 90, 20
SEED = 1
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points."""
    return array("I", (m.end() for m in UNIT.finditer(text)))


def draws(doc_id: object, seed: int = SEED) -> tuple[int, int, int, int]:
    """The four numbers that decide a document's cuts and form."""
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def rearranged(text: str, doc_id: object, seed: int = SEED) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, characters of the prefix and of the middle, and the output of one text."""
    ends = unit_ends(text)
    n = len(ends)
    one, two, cut, order = draws(doc_id, seed)
    if not n or cut % 100 >= CUT_PERCENT or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    first, last = sorted((one % (n + 1), two % (n + 1)))
    a, b = ends[first - 1] if first else 0, ends[last - 1] if last else 0
    if order % 100 < SPM_PERCENT:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def restored(output: str, form: str) -> str:
    """The text, from the output and its form alone."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    left, _, rest = output[len(PREFIX) :].partition(second)
    right, _, middle = rest.partition(MIDDLE)
    return left + middle + right if form == "psm" else right + middle + left


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _cutter(seed: int, texts: bool, fields: T.StructType):  # noqa: ANN202
    @F.pandas_udf(fields)
    def cut(doc_ids: pd.Series, column: pd.Series) -> pd.DataFrame:
        def rows():  # noqa: ANN202
            for d, text in zip(doc_ids, column, strict=True):
                n, form, prefix, middle, output = rearranged(text, d or None, seed)
                digests = (_digest(output), _digest(restored(output, form)))
                yield (n, form, prefix, middle, output, *digests) if texts else (n, form, prefix, middle, *digests)

        out = pd.DataFrame(list(rows()), columns=fields.fieldNames())
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return cut


def filled(docs: DataFrame, seed: int = SEED, texts: bool = True) -> DataFrame:
    """doc_id and :data:`FIELDS` of each row of ``docs`` (doc_id, text); without ``output`` unless ``texts``."""
    fields = T._parse_datatype_string(FIELDS)
    if not texts:
        fields = T.StructType([f for f in fields if f.name != "output"])
    # digits as text: a null among numbers would turn them into floats
    digits = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    cut = _cutter(seed, texts, fields)(digits, F.coalesce(F.col("text"), F.lit("")))
    return docs.select("doc_id", cut.alias("cut")).select("doc_id", "cut.*")


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``, cut at unit borders and put together anew, as digests."""
    return filled(table(spark, sf_dir, "documents"), texts=False)


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     k AS (SELECT *, len(units) AS n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:n], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
