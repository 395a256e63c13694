"""The filter language: text to tokens, to a tree, to a pair of Spark columns (site, samples)."""

from siteloom.expr.compiler import Compiled, compile_filter

__all__ = ["Compiled", "compile_filter"]
