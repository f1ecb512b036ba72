"""Ordered suffix-rule lemmatiser as one generated CASE expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from .text import is_alpha, split_ws, serving_clean_string


def suffix_lemma(w: Column, rules=dims.LEMMA_RULES) -> Column:
    """Words of <= 4 letters stay; first rule that changes the word and leaves
    >= 3 letters wins; else the word itself."""
    n = F.length(w)
    expr = F.when(n <= 4, w)
    for suffix, repl in rules:
        keep = n - len(suffix)
        expr = expr.when(
            w.endswith(suffix) & (keep + len(repl) >= 3),
            F.concat(w.substr(F.lit(1), keep), F.lit(repl)),
        )
    return expr.otherwise(w)


def suffix_lemma_word(w: str, rules=dims.LEMMA_RULES) -> str:
    """``suffix_lemma`` of one word (a test holds both equal)."""
    if len(w) <= 4:
        return w
    for suffix, repl in rules:
        keep = len(w) - len(suffix)
        if keep + len(repl) >= 3 and w.endswith(suffix):
            return w[:keep] + repl
    return w


def lemmatize_array(tokens: Column, rules=dims.LEMMA_RULES) -> Column:
    return F.transform(tokens, lambda w: suffix_lemma(w, rules))


def serving_tokens(c, stop: list[str] | None = None) -> Column:
    """Serving cleaner tokens: alphabetic, not a stopword, longer than 2,
    then suffix-lemmatised."""
    stop = stop if stop is not None else dims.stopwords("frozen")
    toks = F.filter(
        split_ws(serving_clean_string(c)),
        lambda t: is_alpha(t) & ~t.isin(*stop) & (F.length(t) > 2),
    )
    return lemmatize_array(toks)


def serving_clean(c, stop: list[str] | None = None) -> Column:
    return F.array_join(serving_tokens(c, stop), " ")
