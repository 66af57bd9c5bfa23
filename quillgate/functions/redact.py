"""Sensitive-value scan and redaction: Column expressions, their SQL form, and a ledger of the places found.

The SQL form is for engines without look-around: marks are put behind every character that is not part of a
word, and before it where a word ends there.  So the border of a word is a mark that a pattern can consume;
there is one for the match that ends and one for the match that begins at it.
"""

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions.text import SEP, flags, text

STEPS = [
    ("local_windows_path", T.WINDOWS_PATH, "[redacted]"),
    ("local_unix_user_path", T.UNIX_PATH, "[redacted]"),
    ("email_address", T.EMAIL, "[redacted email]"),
    ("phone_number", T.PHONE, "[redacted]"),
    ("api_key_like", T.API_KEY, "[redacted]"),
    ("secret_query_parameter", T.SECRET_VALUE, "$1[redacted]"),
]
#: Classes of a scan with their patterns; trace files are found, not redacted.
CLASSES = {**{name: pattern for name, pattern, _ in STEPS}, "trace_file": T.TRACE_FILE}
#: Begin of a run of 32 key characters.
_LONG_RUN = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{32}"


def hint(t, name):
    """A quick test that every text with a match of the class passes; null where there is none quicker than the pattern.

    Patterns that begin at the border of a word try every word of a text, so they are kept for texts with the
    characters that a match cannot do without.
    """
    return {
        "local_windows_path": lambda: t.contains(":\\"),
        "local_unix_user_path": lambda: t.contains("/"),
        "email_address": lambda: t.contains("@"),
        "api_key_like": lambda: t.contains("sk-") | t.contains("AIza") | t.rlike(_LONG_RUN),
        "secret_query_parameter": lambda: t.contains("="),
    }.get(name, lambda: None)()


def found(t, name):
    """Does the text hold a match of the class?"""
    # every match of a trace file ends with this
    hit = t.rlike(rf"(?i)\.zip(?!{T.WORD_CLASS})" if name == "trace_file" else CLASSES[name])
    quick = hint(t, name)
    return hit if quick is None else quick & hit


def replaced(t, name, pattern, replacement, also=None):
    """The text with the matches of a class replaced, where the class may be in it."""
    quick = hint(t, name)
    new = F.regexp_replace(t, pattern, replacement)
    tests = [x for x in (also, quick) if x is not None]
    return F.when(reduce(lambda a, b: a & b, tests), new).otherwise(t) if tests else new


def sanitize(c):
    """(redacted text, sorted flag array).

    Each class looks at the text as the earlier classes left it, so a class is flagged
    exactly when its own replacement changed the text.
    """
    t = text(c)
    pairs = []
    for name, pattern, replacement in STEPS:
        pairs.append((found(t, name), name))
        t = F.regexp_replace(t, pattern, replacement)
    return t, F.sort_array(flags(*pairs))


def sanitize_columns(df, source, out, flag_out):
    """The same as staged projections, which evaluate every replacement only once."""
    stage, hit = "__redact", F.col("__hit")
    df = df.withColumn(stage, text(source)).withColumn(flag_out, F.lit(""))
    for name, pattern, replacement in STEPS:
        df = df.withColumn("__hit", found(F.col(stage), name)).withColumns({
            flag_out: F.when(hit, F.concat(F.col(flag_out), F.lit(SEP + name))).otherwise(F.col(flag_out)),
            stage: F.when(hit, F.regexp_replace(F.col(stage), pattern, replacement)).otherwise(F.col(stage)),
        })
    return df.withColumn(out, F.col(stage)).drop(stage, "__hit").withColumn(
        flag_out, F.sort_array(F.array_remove(F.split(F.col(flag_out), SEP), ""))
    )


def scan(c, ignore_redacted=True):
    """Sorted array of the sensitive classes found in the text."""
    t = text(c)
    if ignore_redacted:
        t = without_redacted(t)
    return F.sort_array(flags(*[(found(t, name), name) for name in CLASSES]))


def without_redacted(t):
    """The text without secret parameters whose value is redacted."""
    return F.when(t.contains("[redacted]"), F.regexp_replace(t, T.SECRET_PARAM + r"\[redacted\]", "")).otherwise(t)


# --- the ledger --------------------------------------------------------------------------
_OPEN, _CLOSE = "\x02", "\x03"


def span_rows(df, key, column):
    """The ledger: (key, class, start, length) of every match of every class in the whole text, places from 1.

    Every class is searched on its own.  Matches are enclosed by marks in one replacement per class, and the
    pieces between the marks give lengths; only lengths of texts with a match are handed on, and summed up to
    places per text and class.
    """
    t = text(column)

    def lengths(name, pattern):
        pieces = F.split(F.regexp_replace(t, pattern, f"{_OPEN}$0{_CLOSE}"), _OPEN)
        each = F.transform(pieces, lambda p: F.struct(
            F.greatest(F.instr(p, _CLOSE) - 1, F.lit(0)).alias("length"),
            (F.length(p) - F.when(F.contains(p, F.lit(_CLOSE)), 1).otherwise(0)).alias("whole")))
        return F.when(found(t, name), F.struct(F.lit(name).alias("class"), each.alias("pieces")))

    hits = F.array_compact(F.array(*[lengths(n, p) for n, p in CLASSES.items()]))
    rows = df.select(key, F.explode(hits).alias("f")).select(key, "f.class", F.posexplode("f.pieces").alias("at", "p"))
    before = W.partitionBy(key, "class").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.select(key, "class", "at", "p.length", (F.coalesce(F.sum("p.whole").over(before), F.lit(0)) + 1).alias("start"))
    return placed.where("at > 0").select(key, "class", "start", F.col("length").cast("long").alias("length"))


def merged_spans(spans, key):
    """(key, start, length, classes): spans that overlap are one, with the sorted classes of all."""
    end = F.col("start") + F.col("length")
    before = W.partitionBy(key).orderBy("start", "length", "class").rowsBetween(W.unboundedPreceding, -1)
    so_far = W.partitionBy(key).orderBy("start", "length", "class").rowsBetween(W.unboundedPreceding, 0)
    marked = spans.withColumn("__new", F.coalesce(F.col("start") >= F.max(end).over(before), F.lit(True)).cast("int"))
    grouped = marked.withColumn("__group", F.sum("__new").over(so_far))
    return grouped.groupBy(key, "__group").agg(
        F.min("start").alias("start"), (F.max(end) - F.min("start")).alias("length"), F.sort_array(F.collect_set("class")).alias("classes")
    ).drop("__group")


# --- the same as SQL ------------------------------------------------------------------------
# marks: behind a character that is no part of a word; before it, two for the end of a word
_AFTER, _STOP, _EDGE = "\x01", "\x04", "\x06"
_NO_WORD = r"[^\p{L}\p{N}_]"
_BEGIN, _END, _MAYBE = f"(?:^|{_AFTER})", f"(?:$|{_STOP})", f"(?:{_STOP}{_EDGE})?"
#: A match that begins with a mark of punctuation, right behind a word.
_BEHIND = f"{_STOP}?{_EDGE}"
_MAIL_CHAR = rf"(?:[{T.LETTER_CHARS}0-9_]|{_MAYBE}[.%+\-]{_AFTER})"
_KEY_CHAR = rf"(?:[A-Za-z0-9_]|{_MAYBE}-{_AFTER})"
#: class: (is the text marked, pattern, groups of the match, and behind it)
_SQL_CLASSES = {
    "local_windows_path": (False, T.WINDOWS_PATH, r"\0", ""),
    "local_unix_user_path": (False, T.UNIX_PATH, r"\0", ""),
    "email_address": (
        True, rf"(?:{_BEGIN}([{T.LETTER_CHARS}0-9_])|{_BEHIND}([.%+\-]{_AFTER}))({_MAIL_CHAR}*{_MAYBE}@{_AFTER}"
        rf"(?:[{T.LETTER_CHARS}0-9]|{_MAYBE}[.\-]{_AFTER})+{_MAYBE}\.{_AFTER}[{T.LETTER_CHARS}]{{2,}}){_END}", r"\1\2\3", ""),
    "phone_number": (
        True, rf"{_BEGIN}((?:\+{_AFTER})?\p{{Nd}}(?:\p{{Nd}}|{_MAYBE}[{T.SPACE_CHARS}().\-]{_AFTER}){{7,}}\p{{Nd}}){_END}", r"\1", ""),
    "api_key_like": (
        True, rf"(?:{_BEGIN}(sk{_MAYBE}-{_AFTER}{_KEY_CHAR}{{15,}}|AIza{_KEY_CHAR}{{19,}}|[A-Za-z0-9_]{_KEY_CHAR}{{30,}})|"
        rf"{_BEHIND}(-{_AFTER}{_KEY_CHAR}{{30,}}))(?:([A-Za-z0-9_]){_END}|({_MAYBE}-{_AFTER})({T.WORD_CLASS}))", r"\1\2\3\4", r"\5"),
    "secret_query_parameter": (False, T.SECRET_VALUE, r"\0", ""),
    "trace_file": (
        True, rf"(?i)({_MAYBE}\.{_AFTER}trace{_MAYBE}\.{_AFTER}zip|trace_[^|;\n\r\t]+\.{_AFTER}zip|{_MAYBE}\.{_AFTER}zip){_END}", r"\1", ""),
}


def _q(value):
    return "'" + value.replace("'", "''") + "'"


def _marked_sql(x, marked):
    if not marked:
        return x
    after = rf"regexp_replace({x}, '({_NO_WORD})', '\1' || chr(1), 'g')"
    return rf"regexp_replace({after}, '({T.WORD_CLASS})({_NO_WORD})', '\1' || chr(4) || chr(6) || '\2', 'g')"


def _unmarked_sql(x):
    return f"translate({x}, chr(1) || chr(4) || chr(6), '')"


def _found_sql(name, x):
    marked, pattern, *_ = _SQL_CLASSES[name]
    return f"regexp_matches({_marked_sql(x, marked)}, {_q(pattern)})"


def sanitize_sql(source, column, name="redacted"):
    """CTE texts up to ``name``: the rows of ``source`` with ``column`` redacted and the sorted list ``found`` of classes."""
    ctes, before = [f"{name}_0 as (select *, []::varchar[] as found, false as hit from {source})"], f"{name}_0"
    for i, (step, _, replacement) in enumerate(STEPS, 1):
        marked, pattern, _, right = _SQL_CLASSES[step]
        new = r"\1[redacted]" if "$1" in replacement else replacement + right
        cleaned = _unmarked_sql(f"regexp_replace({_marked_sql(column, marked)}, {_q(pattern)}, {_q(new)}, 'g')")
        ctes.append(
            f"{name}_{i} as (select * replace (case when hit then {cleaned} else {column} end as {column}, "
            f"case when hit then list_append(found, {_q(step)}) else found end as found) "
            f"from (select * replace ({_found_sql(step, column)} as hit) from {before}))")
        before = f"{name}_{i}"
    ctes.append(f"{name} as (select * exclude (hit) replace (list_sort(found) as found) from {before})")
    return ",\n".join(ctes)


def scan_sql(x):
    """Sorted list of the classes found in a text."""
    rest = f"regexp_replace({x}, {_q(T.SECRET_PARAM + r'\[redacted\]')}, '', 'g')"
    cases = ", ".join(f"case when {_found_sql(n, rest)} then {_q(n)} end" for n in CLASSES)
    return f"list_sort(list_filter([{cases}], lambda f: f is not null))"


def span_rows_sql(source, key, x):
    """The ledger (key, class, start, length) of a table's texts."""
    parts = []
    for name in CLASSES:
        marked, pattern, body, right = _SQL_CLASSES[name]
        shown = f"regexp_replace({_marked_sql(x, marked)}, {_q(pattern)}, {_q(_OPEN + body + _CLOSE + right)}, 'g')"
        parts.append(
            f"select {key}, {_q(name)} as class, generate_subscripts(p, 1) as nth, unnest(p) as piece from ("
            f"select {key}, string_split({_unmarked_sql(shown)}, chr(2)) as p from {source} where {_found_sql(name, x)})")
    return (
        f"select {key}, class, cast(start as bigint) as start, cast(length as bigint) as length from ("
        f"select {key}, class, nth, strpos(piece, chr(3)) - 1 as length, "
        f"coalesce(sum(length(piece) - case when contains(piece, chr(3)) then 1 else 0 end) over "
        f"(partition by {key}, class order by nth rows between unbounded preceding and 1 preceding), 0) + 1 as start "
        f"from ({' union all '.join(parts)})) where nth > 1")
