"""String columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Letters, digits and underscore of any script: what a word is made of.
WORD_CLASS = r"\p{L}\p{N}_"
_WORD = f"[{WORD_CLASS}]"


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(_as_column(text).rlike(r"(?U)\S"), F.lit(False))


def tokens(lower_text: Column) -> Column:
    """Maximal runs of word characters."""
    return F.split(lower_text, f"[^{WORD_CLASS}]+")


def word_regex(term: str) -> str:
    """A term bounded as by ``\\b`` on both sides, with the word class spelled out.

    Next to a word character the neighbour must not be one; next to any other
    character the neighbour must be one.  The term itself comes first in the
    pattern and both neighbours are looked at after it: most positions of a text
    then fail on one character.
    """
    import re

    def word(ch: str) -> bool:
        return ch == "_" or ch.isalnum()

    quoted = re.sub(r"([^\w\s])", r"\\\1", term)
    left = f"(?<!{_WORD}{quoted})" if word(term[0]) else f"(?<={_WORD}{quoted})"
    right = f"(?!{_WORD})" if word(term[-1]) else f"(?={_WORD})"
    return quoted + left + right


def redact_email(email: Column | str) -> Column:
    """First and last character of the local part, stars between; short ones all stars."""
    e = _as_column(email)
    local = F.regexp_extract(e, r"(?s)^([^@]*)", 1)
    domain = F.regexp_extract(e, r"(?s)^[^@]*@(.*)$", 1)
    n = F.length(local)
    masked = F.when(n <= 2, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(local, 1, 1), F.repeat(F.lit("*"), n - 2), F.right(local, F.lit(1)))
    )
    return F.when(F.coalesce(F.length(e), F.lit(0)) == 0, F.lit("")).otherwise(
        F.concat(masked, F.lit("@"), domain)
    )


def display_name(email: Column | str) -> Column:
    """Local part with dots as spaces, every run of letters capitalised."""
    local = F.replace(F.split_part(_as_column(email), F.lit("@"), F.lit(1)), F.lit("."), F.lit(" "))
    runs = F.regexp_extract_all(local, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def last_label(domain: Column | str) -> Column:
    """Text after the last dot in lower case; empty for null."""
    return F.lower(F.element_at(F.split(F.coalesce(_as_column(domain), F.lit("")), r"\."), -1))


def index_name(prefix: str, source: Column | str, ts: Column | str) -> Column:
    """Route key: one target per source and day."""
    return F.concat_ws(
        "-",
        F.lit(prefix),
        F.translate(_as_column(source), ".", "_"),
        F.date_format(_as_column(ts), "yyyy.MM.dd"),
    )


def techniques(tags: Column | str) -> Column:
    """Technique ids named by tags like ``attack.t1567.002``, in upper case."""
    pattern = r"^attack\.(t\d+(?:\.\d+)?)$"
    hits = F.filter(_as_column(tags), lambda t: t.rlike(pattern))
    return F.transform(hits, lambda t: F.upper(F.regexp_extract(t, pattern, 1)))
