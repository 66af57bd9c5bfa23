"""Text helpers as Column expressions.

Blank text, not null, means "missing" everywhere, so helpers take null as blank.
Flag lists are built with ``concat_ws``/``split`` and native array functions instead of
lambda functions, which keeps the surrounding projection inside whole-stage codegen.
"""

import re
from functools import reduce

from pyspark.sql import functions as F

# characters that count as white space, and the same set as a regex class
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
WS = (
    r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
SEP = "\x1e"


def col(c):
    return F.col(c) if isinstance(c, str) else c


def text(c):
    """Null-safe text."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c):
    """Trim every kind of white space, not only spaces."""
    return F.trim(col(c), F.lit(WS_CHARS))


def clean(c):
    """Null-safe, trimmed text."""
    return strip(text(c))


def collapse(c):
    """Trim and squeeze inner white space to single spaces."""
    return strip(F.regexp_replace(text(c), WS + "+", " "))


def blank_to_null(c):
    return F.nullif(clean(c), F.lit(""))


def first_present(*cols, skip=()):
    """First column with text in it; ``skip`` lists placeholders that count as blank."""
    parts = []
    for c in cols:
        value = clean(c)
        if skip:
            value = F.when(~value.isin(list(skip)), value)
        parts.append(F.nullif(value, F.lit("")))
    return F.coalesce(*parts, F.lit(""))


def any_of(conditions):
    return reduce(lambda a, b: a | b, conditions)


def _needed(terms):
    # a term that contains another term of the list can never decide the outcome
    terms = sorted(set(terms))
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def _sql_text(value):
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def has_any(lowered, terms):
    """Does the (already lower-case) text contain one of the terms?

    A column name is the quick way: the whole test is then handed over as one expression.
    """
    if isinstance(lowered, str):
        return F.expr(" or ".join(f"contains(`{lowered}`, {_sql_text(t)})" for t in _needed(terms)))
    return any_of([lowered.contains(t) for t in _needed(terms)])


def starts_any(lowered, prefixes):
    if isinstance(lowered, str):
        return F.expr(" or ".join(f"startswith(`{lowered}`, {_sql_text(p)})" for p in prefixes))
    return any_of([lowered.startswith(p) for p in prefixes])


def array_of(*items):
    """Array of the given text columns without nulls and blanks."""
    joined = F.concat_ws(SEP, *items)
    return F.array_remove(F.split(joined, SEP), "")


def flags(*pairs):
    """Ordered array of the labels whose condition holds."""
    return array_of(*[F.when(cond, F.lit(label)) for cond, label in pairs])


def split_list(c, seps):
    """Split at the separators, trim the items, drop blanks (order kept)."""
    cls = "[" + re.escape(seps).replace("\\\n", "\n") + "]"
    return F.array_remove(F.split(clean(c), f"{WS}*{cls}{WS}*"), "")


def split_flags(c):
    """Flag text -> distinct lower-case flags (newline, semicolon, comma or bar between)."""
    return F.array_distinct(split_list(F.lower(text(c)), "\n;,|"))


def join_list(arr):
    """Array -> text with a spaced bar between the items."""
    return F.array_join(arr, " | ")


def join_present(*cols, sep=" | "):
    """Join the non-blank columns."""
    return F.concat_ws(sep, *[blank_to_null(c) for c in cols])


def dedupe(arr):
    return F.array_distinct(arr)


def lits(values):
    return F.array(*[F.lit(v) for v in values])


def intersect_sorted(arr, values):
    return F.sort_array(F.array_intersect(arr, lits(values)))


def overlaps(arr, values):
    return F.arrays_overlap(arr, lits(values))


def word_count(c, slash_splits=True):
    """Number of white-space separated words."""
    t = text(c)
    t = strip(F.translate(t, "/", " ") if slash_splits else t)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, WS + "+")))


def more_words(c, n, slash_splits=True):
    """Has the text more than ``n`` white-space separated words?  Only its first ``n`` + 1 words are read."""
    space = WS[:-1] + "/]" if slash_splits else WS
    # ASCII marks and letters first: the full class is a chain of ranges
    word = f"(?:[!-.0-~]|(?!{space})(?s:.))" if slash_splits else f"(?:[!-~]|(?!{space})(?s:.))"
    return text(c).rlike(rf"\A{space}*+(?:{word}++{space}++){{{n}}}+{word}")


def stable_id(*cols):
    """16-hex id over the lower-case non-blank parts; blank when all parts are blank."""
    payload = F.concat_ws("\n", *[F.nullif(F.lower(clean(c)), F.lit("")) for c in cols])
    return F.when(payload == "", F.lit("")).otherwise(F.left(F.sha2(payload, 256), F.lit(16)))


def bucket_of(key, n):
    """First 8 hex digits of the md5 of ``key`` as an integer, modulo ``n``."""
    return F.conv(F.left(F.md5(key), F.lit(8)), 16, 10).cast("bigint") % n


def loose_bool(c, extra=("review",)):
    return F.lower(clean(c)).isin(["true", "waar", "yes", "1", *extra])


def yes_no(c):
    """Render truth words as yes/no and leave everything else alone."""
    low = F.lower(clean(c))
    return (
        F.when(low.isin("true", "waar", "yes", "1"), "yes")
        .when(low.isin("false", "onwaar", "no", "0"), "no")
        .otherwise(text(c))
    )


def slug(c):
    s = F.trim(F.regexp_replace(F.lower(clean(c)), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(s == "", F.lit("client")).otherwise(s)


def before(c, delimiter):
    """Text before the first delimiter, the whole text when there is none."""
    return F.substring_index(text(c), delimiter, 1)


def first_word(c):
    return F.element_at(F.split(clean(c), WS + "+"), 1)


def rest_words(c):
    rest = F.regexp_replace(clean(c), f"^[^{WS[1:-1]}]+{WS}*", "")
    return F.regexp_replace(rest, WS + "+", " ")


def shorten(c, limit=420):
    """Repair damaged punctuation, squeeze white space, cut with an ellipsis."""
    from quillgate.terms import TEXT_REPAIRS

    t = text(c)
    for bad, good in TEXT_REPAIRS:
        t = F.replace(t, F.lit(bad), F.lit(good))
    t = collapse(t)
    cut = F.concat(F.rtrim(F.left(t, F.lit(limit - 3)), F.lit(WS_CHARS)), F.lit("..."))
    return F.when(F.length(t) <= limit, t).otherwise(cut)


def clean_notes(c, limit=520):
    from quillgate.terms import NOISY_NOTES

    t = text(c)
    for noise in NOISY_NOTES:
        t = F.replace(t, F.lit(noise), F.lit(""))
    t = F.trim(F.replace(t, F.lit(" |  | "), F.lit(" | ")), F.lit(" |"))
    return shorten(t, limit)


def cell_lines(c, limit=900):
    t = shorten(c, limit)
    return F.replace(F.replace(t, F.lit(" | "), F.lit("\n")), F.lit("; "), F.lit("\n"))


def keywords(c):
    """Distinct words of four or more characters that are no stop words."""
    from quillgate.terms import STOPWORDS

    low = F.lower(text(c))
    words = F.regexp_extract_all(low, F.lit(r"[a-z][a-z0-9'-]{3,}"), 0)
    kept = F.array_except(words, lits(STOPWORDS))
    tidy = F.regexp_replace(F.array_join(kept, "\n"), "'+(?=\n|$)", "")
    # words without an apostrophe have nothing to lose at their end
    return F.when(low.contains("'"), F.array_remove(F.array_distinct(F.split(tidy, "\n")), "")).otherwise(kept)


def token_estimate(c):
    """A quarter of the characters, half-even rounded, at least one."""
    return F.greatest(F.lit(1), F.bround(F.length(text(c)) / F.lit(4.0), 0).cast("int"))


def lookup(c, mapping, default):
    """Map a column through a small fixed dictionary."""
    expr = None
    for key, value in mapping.items():
        expr = F.when(col(c) == key, F.lit(value)) if expr is None else expr.when(col(c) == key, F.lit(value))
    return expr.otherwise(default if not isinstance(default, (str, int, float)) else F.lit(default))


def filled(template, values):
    """A fixed text with {name} places, filled with columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[
        text(values[part]) if i % 2 else F.lit(part) for i, part in enumerate(parts) if i % 2 or part])
