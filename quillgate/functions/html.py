"""Page parse as column functions: title, visible text and links of one HTML text.

Comments go first, then elements that hold no page text (up to their end tag, or to the end of a page
that was cut off), then all other tags become blanks and entities become characters.  An element nested
in another of its own name ends with the inner end tag.
"""

from pyspark.sql import functions as F

from quillgate import terms as T

_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
#: What follows a tag's name: up to the first > outside of quoted attribute values.
_REST = r"""(?:[^'">]++|"[^"]*+"|'[^']*+')*+"""
_TAG = rf"<[a-zA-Z/!?]{_REST}(?:>|\z)"
_TITLE = rf"(?is)<title\b{_REST}>(.*?)(?:</title|\z)"
#: An anchor with an href: the quoted or bare value, and what follows up to the next end or start of an anchor.
_ANCHOR = rf"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+){_REST}>(.*?)(?:</a\s*>|<a\s|\z)"""


def _element(tag):
    return rf"(?is)<{tag}\b{_REST}>.*?(?:</{tag}\s*>|\z)"


def _bound(c, fn):
    """fn(c) with c evaluated once, however often fn uses it."""
    return F.element_at(F.transform(F.array(c), fn), 1)


def _squeeze(c):
    return F.trim(F.regexp_replace(c, r"[\s\x{A0}]+", " "))


def _number(part):
    """Text after "&#": the character of its number, and the rest; texts without a number keep the mark."""
    whole = F.regexp_extract(part, r"^(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?", 0)
    decimal, hexadecimal = F.regexp_extract(whole, r"^([0-9]+)", 1), F.regexp_extract(whole, r"^[xX]([0-9a-fA-F]+)", 1)
    code = F.when(decimal != "", decimal.cast("int")).otherwise(F.conv(hexadecimal, 16, 10).cast("int"))
    good = (whole != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(good, F.concat(char, F.substring(part, F.length(whole) + 1, F.length(part)))).otherwise(F.concat(F.lit("&#"), part))


def entities(c):
    """Characters for numeric and the common named entities; "&amp;" last, so nothing is decoded twice."""
    def decoded(t):
        parts = F.split(t, "&#", -1)
        numbered = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _number), ""))
        t = F.when(F.contains(t, F.lit("&#")), numbered).otherwise(t)
        for name, char in T.ENTITIES.items():
            t = F.regexp_replace(t, f"&{name};?" if name in T.BARE_ENTITIES else f"&{name};", char)
        return t

    return _bound(c, lambda t: F.when(F.contains(t, F.lit("&")), decoded(t)).otherwise(t))


def title(html):
    return _squeeze(entities(F.regexp_replace(F.regexp_extract(F.coalesce(html, F.lit("")), _TITLE, 1), _TAG, " ")))


def visible_text(html):
    """Text outside of comments, scripts, styles, forms and the page's head and foot bars."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENT, " ")
    for tag in T.DROPPED_TAGS:
        c = F.regexp_replace(c, _element(tag), " ")
    return _squeeze(entities(F.regexp_replace(c, _TAG, " ")))


def links(html):
    """array<struct<href, label>> of anchors with an href, in page order, also of head and foot bars."""
    c = F.regexp_replace(F.coalesce(html, F.lit("")), _COMMENT, "")
    for tag in ("script", "style"):
        c = F.regexp_replace(c, _element(tag), " ")
    hrefs = F.regexp_extract_all(c, F.lit(_ANCHOR), 1)
    labels = F.regexp_extract_all(c, F.lit(_ANCHOR), 2)
    return F.zip_with(hrefs, labels, lambda h, x: F.struct(
        F.trim(entities(F.regexp_replace(h, r"""^["']|["']$""", ""))).alias("href"),
        _squeeze(entities(F.regexp_replace(x, _TAG, " "))).alias("label")))


# --- the same in SQL for the check engine -------------------------------------------------------
def _pattern_sql(pattern):
    """The pattern for an engine that never tries again, so it knows no possessive marks."""
    return pattern.replace("++", "+").replace("*+", "*").replace("'", "''")


def _replace_sql(expr, pattern, by):
    return f"regexp_replace({expr}, '{_pattern_sql(pattern)}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"


#: The character of a numeric entity whose mark "&#" is cut off, and the rest.
_NUMBER_SQL = r"""list_transform([{'p': p, 'w': regexp_extract(p, '^(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?', 0)}], lambda n:
  list_transform([case when n.w = '' then 0 when regexp_matches(n.w, '^[0-9]') then regexp_extract(n.w, '^([0-9]+)', 1)::int
    else ('0x' || regexp_extract(n.w, '^[xX]([0-9a-fA-F]+)', 1))::int end], lambda c:
    case when c between 1 and 1114111 and not c between 55296 and 57343 then chr(c) || substr(n.p, length(n.w) + 1) else '&#' || n.p end)[1])[1]"""


def _entities_sql(expr):
    expr = f"list_transform([string_split({expr}, '&#')], lambda q: q[1] || array_to_string(list_transform(q[2:], lambda p: {_NUMBER_SQL}), ''))[1]"
    for name, char in T.ENTITIES.items():
        expr = _replace_sql(expr, f"&{name};?" if name in T.BARE_ENTITIES else f"&{name};", char)
    return expr


def _squeeze_sql(expr):
    return f"trim({_replace_sql(expr, '[' + chr(92) + 's' + chr(92) + 'x{A0}]+', ' ')})"


def title_sql(html="html"):
    found = f"regexp_extract({html}, '{_pattern_sql(_TITLE)}', 1)"
    return _squeeze_sql(_entities_sql(_replace_sql(found, _TAG, " ")))


def visible_sql(html="html"):
    expr = _replace_sql(html, _COMMENT, " ")
    for tag in T.DROPPED_TAGS:
        expr = _replace_sql(expr, _element(tag), " ")
    return _squeeze_sql(_entities_sql(_replace_sql(expr, _TAG, " ")))


def links_sql(html="html"):
    """List of {href, label} structs."""
    expr = _replace_sql(html, _COMMENT, "")
    for tag in ("script", "style"):
        expr = _replace_sql(expr, _element(tag), " ")
    anchor = _pattern_sql(_ANCHOR)
    pairs = f"list_zip(regexp_extract_all({expr}, '{anchor}', 1), regexp_extract_all({expr}, '{anchor}', 2))"
    href = f"trim({_entities_sql(_replace_sql('x[1]', chr(94) + '[' + chr(34) + chr(39) + ']|[' + chr(34) + chr(39) + ']$', ''))})"
    label = _squeeze_sql(_entities_sql(_replace_sql("x[2]", _TAG, " ")))
    return f"list_transform({pairs}, lambda x: {{'href': {href}, 'label': {label}}})"
