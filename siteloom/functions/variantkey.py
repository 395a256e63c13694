"""The public variant key: contig, position and alleles in 64 bits, ordered by contig and position.

Short alleles of A, C, G, T are coded reversibly: four bits each for the lengths, then two bits a base. Others are hashed:
blocks of six letters, five bits a letter, are mixed in the manner of MurmurHash3, REF first, then a separator, then ALT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the public encoding and of MurmurHash3.
MIX_1, MIX_2, ADD = 0xCC9E2D51, 0x1B873593, 0xE6546B64
FINAL_1, FINAL_2 = 0x85EBCA6B, 0xC2B2AE35
SEPARATOR = 3
CONTIGS = {"X": 23, "Y": 24, "M": 25, "MT": 25}
_MASK = 0xFFFFFFFF


def contig_code(name: str) -> int:
    """1 to 22, X, Y, M or MT, with or without ``chr``; 0 for others."""
    bare = name[3:] if name[:3].lower() == "chr" and len(name) > 3 else name
    if bare[:1].isdigit():
        return int(bare) if bare.isdigit() and int(bare) <= 255 else 0
    return CONTIGS.get(bare.upper(), 0)


def _mixed(k: int, h: int) -> int:
    k = k * MIX_1 & _MASK
    k = (k >> 17 | k << 15) & _MASK
    h ^= k * MIX_2 & _MASK
    h = (h >> 19 | h << 13) & _MASK
    return (h * 5 + ADD) & _MASK


def _string_hash(text: str) -> int:
    h = 0
    for at in range(0, len(text), 6):
        block = 0
        for i, c in enumerate(text[at : at + 6]):
            block ^= (27 if c < "A" else ord(c) - (96 if c >= "a" else 64)) << 1 + 5 * (5 - i)
        h = _mixed(block & _MASK, h)
    return h


def allele_code(ref: str, alt: str) -> int:
    """31 bits of REF and ALT."""
    both = (ref + alt).upper()
    if len(both) <= 11 and not set(both) - set("ACGT"):
        h, at = len(ref) << 27 | len(alt) << 23, 23
        for c in both:
            at -= 2
            h |= "ACGT".index(c) << at
        return h & _MASK
    h = _mixed(_string_hash(alt), _mixed(SEPARATOR, _string_hash(ref)))
    h = (h ^ h >> 16) * FINAL_1 & _MASK
    h = (h ^ h >> 13) * FINAL_2 & _MASK
    return (h ^ h >> 16) >> 1 | 1


@F.pandas_udf(T.StringType())
def variant_key_hex(chrom: pd.Series, pos: pd.Series, ref: pd.Series, alt: pd.Series) -> pd.Series:
    """16 hex digits; ``pos`` from 0. Contigs and pairs of alleles are coded once a batch."""
    contigs = {c: contig_code(c) for c in chrom.unique()}
    pairs = pd.MultiIndex.from_arrays([ref, alt])
    which, distinct = pairs.factorize()
    codes = np.array([allele_code(r, a) for r, a in distinct], np.uint64)[which] if len(which) else np.zeros(0, np.uint64)
    key = chrom.map(contigs).to_numpy(np.uint64) << np.uint64(59) | pos.to_numpy(np.uint64) << np.uint64(31) | codes
    return pd.Series([f"{k:016x}" for k in key.tolist()])
