"""Text and scalar functions as Column -> Column builders (no Python UDFs).

Python's ``\\s``, ``isalpha`` and ``isupper`` are Unicode-aware; the Java
regex flag ``(?U)`` and the ``\\p{L}`` / ``\\p{Lu}`` classes give the same
meaning inside Spark's JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims

WS = r"(?U)\s"
NON_WS_RUN = r"(?U)\S+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# T1 ------------------------------------------------------------------------
def char_length(c) -> Column:
    """Length in code points (as Python ``len``)."""
    return F.length(_c(c))


# T2 ------------------------------------------------------------------------
def word_count(c) -> Column:
    """Number of whitespace-separated words; 0 for empty or blank text."""
    return F.regexp_count(_c(c), F.lit(NON_WS_RUN))


# T3 ------------------------------------------------------------------------
def strip_ws(c) -> Column:
    """Strip leading/trailing Unicode whitespace (``F.trim`` strips spaces only)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def squeeze_ws(c) -> Column:
    """Every whitespace run becomes one space, then strip."""
    return F.trim(F.regexp_replace(_c(c), r"(?U)\s+", " "))   # spaces are all that is left to strip


# P2 ------------------------------------------------------------------------
def as_text(c, null_as_nan: bool = False) -> Column:
    """Cast to string; null -> '' (or the literal 'nan' in legacy mode)."""
    return F.coalesce(_c(c).cast("string"), F.lit("nan" if null_as_nan else ""))


# T4 ------------------------------------------------------------------------
def normalize_quotes(c) -> Column:
    """Curly/low quotes to straight, squeeze whitespace, strip outer '"' then
    outer "'" then whitespace (each end on its own)."""
    x = F.translate(_c(c), "“”„‘’", "\"\"\"''")
    x = F.regexp_replace(x, r"(?U)\s+", " ")
    x = F.regexp_replace(x, r'^"+|"+$', "")
    x = F.regexp_replace(x, r"^'+|'+$", "")
    return strip_ws(x)


# T5 ------------------------------------------------------------------------
def combine_title_review(title, review) -> Column:
    return F.concat(_c(title), F.lit(". "), _c(review))


def first_line(c, max_chars: int | None = None) -> Column:
    """Title stand-in: the first line of a text (optionally cut)."""
    x = F.substring_index(_c(c), "\n", 1)
    return F.substring(x, 1, max_chars) if max_chars else x


# T6 ------------------------------------------------------------------------
def lower(c) -> Column:
    return F.lower(_c(c))


# T7 / T8 -------------------------------------------------------------------
URL_PATTERNS = {
    # offline cleaner: unescaped dot kept as written
    "loose": r"http\S+|www.\S+",
    # NLP cleaner, applied as two steps
    "strict": (r"https?://\S+", r"www\.\S+"),
    # serving cleaner: URLs and e-mails in one pattern
    "serving": r"https?://\S+|www\.\S+|(?<!\S)\S+@\S+",
}
# a match reaches back to the start of its run of non-space characters; begun only there, a long run takes linear time
EMAIL_PATTERNS = {"loose": r"(?<!\S)\S+@\S+", "dotted": r"(?<!\S)\S+@\S+\.\S+"}


def _u(p: str) -> str:
    return "(?U)" + p


def remove_urls(c, variant: str = "strict") -> Column:
    x = _c(c)
    pats = URL_PATTERNS[variant]
    for p in (pats if isinstance(pats, tuple) else (pats,)):
        x = F.regexp_replace(x, _u(p), "")
    return x


def remove_emails(c, variant: str = "loose") -> Column:
    return F.regexp_replace(_c(c), _u(EMAIL_PATTERNS[variant]), "")


# T9 ------------------------------------------------------------------------
def keep_ascii_letters(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)[^a-z\s]", "")


# T10 -----------------------------------------------------------------------
def delete_ascii_punct(c) -> Column:
    return F.translate(_c(c), dims.ASCII_PUNCTUATION, "")


def remove_punctuation(c) -> Column:
    """Curly quotes/dashes and HTML entities to space, delete ASCII
    punctuation, squeeze whitespace."""
    x = F.regexp_replace(_c(c), r"(?U)[‘’“”„–—]|&\w+;", " ")
    return squeeze_ws(delete_ascii_punct(x))


# T11 -----------------------------------------------------------------------
def clean_letters(c) -> Column:
    """Offline cleaner: lower, drop URLs (loose) and e-mails, keep a-z and
    whitespace, squeeze."""
    x = lower(c)
    x = remove_urls(x, "loose")
    x = remove_emails(x, "loose")
    x = keep_ascii_letters(x)
    return squeeze_ws(x)


# T12 -----------------------------------------------------------------------
def split_ws(c) -> Column:
    """Whitespace split without empty strings (Python ``str.split()``)."""
    return F.regexp_extract_all(_c(c), F.lit(NON_WS_RUN), 0)


def is_alpha(x: Column) -> Column:
    return x.rlike(r"^\p{L}+$")


def tokenize(c, min_len: int = 2) -> Column:
    """Alphabetic tokens of at least ``min_len`` letters, order and duplicates kept:
    in one scan of the text, without a test of each run of non-space characters."""
    return F.regexp_extract_all(_c(c), F.lit(rf"(?U)(?<!\S)\p{{L}}{{{max(min_len, 1)},}}+(?!\S)"), 0)


# J3 (in-array form) ----------------------------------------------------------
def drop_stopwords(tokens, words: list[str]) -> Column:
    """Remove stopwords from an array, keeping order and duplicates (not
    array_except).  ``isin`` over many literals becomes a hashed InSet."""
    return F.filter(_c(tokens), lambda t: ~t.isin(*words))


# T17 -----------------------------------------------------------------------
def count_char(c, ch: str) -> Column:
    x = _c(c)
    return (F.length(x) - F.length(F.replace(x, F.lit(ch), F.lit("")))).cast("int")


# T18 -----------------------------------------------------------------------
def uppercase_ratio(c) -> Column:
    x = _c(c)
    return F.regexp_count(x, F.lit(r"\p{Lu}")) / F.greatest(F.length(x), F.lit(1))


# T19 -----------------------------------------------------------------------
def safe_ratio(num, den) -> Column:
    """num / den, null when den is 0 (ANSI mode raises on /0)."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


# T20 -----------------------------------------------------------------------
def contains_any(c, words: list[str]) -> Column:
    x = _c(c)
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


# T21 -----------------------------------------------------------------------
def round_half_even(c, dp: int) -> Column:
    """Python's round(): ties to even."""
    return F.bround(_c(c), dp)


def pct(part, whole, dp: int = 2) -> Column:
    return F.round(F.try_divide(_c(part) * 100.0, _c(whole)), dp)


# T22 -----------------------------------------------------------------------
def stable_id(*cols) -> Column:
    """Deterministic id for replays (md5 of the parts joined with '|')."""
    return F.md5(F.concat_ws("|", *[_c(c).cast("string") for c in cols]))


def seeded_order_key(id_col, seed: int = 42) -> Column:
    """md5(id || '|' || seed): equal in Spark and in SQL engines, repeatable."""
    return F.md5(F.concat(_c(id_col).cast("string"), F.lit(f"|{seed}")))


# T23 -----------------------------------------------------------------------
def map_get_or_zero(m, key: str) -> Column:
    return F.coalesce(F.try_element_at(_c(m), F.lit(key)), F.lit(0.0))


# T26 -----------------------------------------------------------------------
def score_to_percent(c) -> Column:
    return (_c(c) + 1.0) / 2.0 * 100.0


# T15 -----------------------------------------------------------------------
def nlp_clean_string(c) -> Column:
    """Offline NLP cleaner up to tokenisation: lower, URLs, e-mails, punctuation."""
    x = lower(c)
    x = remove_urls(x, "strict")
    x = remove_emails(x, "dotted")
    x = strip_ws(x)
    return remove_punctuation(x)


def serving_clean_string(c) -> Column:
    """Serving cleaner up to the token filter: lower, URLs+e-mails, ASCII punctuation, squeeze."""
    x = lower(c)
    x = remove_urls(x, "serving")
    x = delete_ascii_punct(x)
    return squeeze_ws(x)


def random_id() -> Column:
    """T22 random form: a UUID per row (non-deterministic; use ``stable_id`` for replays)."""
    return F.uuid()
