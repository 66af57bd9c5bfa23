"""JSON text helpers."""

from pyspark.sql import functions as F

from quillgate.functions.text import text


def object_text(c):
    """The text itself when it is a JSON object, else the outermost {...} in it."""
    t = text(c)
    is_object = F.coalesce(
        F.schema_of_variant(F.try_parse_json(t)).startswith("OBJECT"), F.lit(False)
    )
    return F.when(is_object, t).otherwise(F.regexp_extract(t, r"(?s)\{.*\}", 0))


def parse_object(c, schema):
    """Parsed struct, null when the reply holds no JSON object."""
    candidate = object_text(c)
    usable = F.try_parse_json(F.nullif(candidate, F.lit(""))).isNotNull()
    return F.when(usable, F.from_json(candidate, schema))


# --- building: byte-stable JSON text ---------------------------------------------------------
# escapes of JSON text, and of control characters that have no letter of their own
_ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")]
_CONTROLS = [chr(i) for i in range(32) if chr(i) not in "\n\r\t\b\f"]


def _unit(code):
    return F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(code), 4, "0")))


def _escaped_char(char):
    """A character that is not ASCII as one or two \\u escapes."""
    code = F.conv(F.hex(F.encode(char, "UTF-32")), 16, 10).cast("int")
    rest = code - 0x10000
    pair = F.concat(_unit(F.shiftright(rest, 10) + 0xD800), _unit(rest.bitwiseAND(0x3FF) + 0xDC00))
    return F.when(code < 0x10000, _unit(code)).otherwise(pair)


def _wide(t):
    """Has a text characters beyond U+007E?  Lengths tell it without a search by a negated class, which is slow."""
    return (F.octet_length(t) != F.length(t)) | t.contains("\x7f")


def quoted(c, ascii_only=True):
    """JSON string of a text (null: the empty text); ``ascii_only`` escapes all characters that are not ASCII.

    Only the distinct characters that need it are replaced, and only in texts that have any.  Most texts have none:
    they are searched once and stay as they are.
    """
    plain = t = text(c)
    for char, escape in _ESCAPES:
        t = F.replace(t, F.lit(char), F.lit(escape))
    controls = t
    for char in _CONTROLS:
        controls = F.replace(controls, F.lit(char), F.lit(f"\\u{ord(char):04x}"))
    t = F.when(plain.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), controls).otherwise(t)
    shown = F.when(plain.rlike(r"""[\x00-\x1f"\\]"""), t).otherwise(plain)
    if ascii_only:
        others = F.array_distinct(F.regexp_extract_all(plain, F.lit(r"([^\x00-\x7e])"), 1))
        shown = F.when(_wide(plain), F.aggregate(others, t, lambda done, x: F.replace(done, x, _escaped_char(x)))).otherwise(shown)
    return F.concat(F.lit('"'), shown, F.lit('"'))


def number(c):
    """JSON number of a whole number (null: null)."""
    return F.coalesce(c.cast("string") if not isinstance(c, str) else F.col(c).cast("string"), F.lit("null"))


def truth(c):
    """JSON true or false (null: null)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c, "true").when(~c, "false").otherwise("null")


def json_list(items):
    """JSON list of an array of JSON texts (null: empty)."""
    return F.concat(F.lit("["), F.coalesce(F.array_join(items, ", "), F.lit("")), F.lit("]"))


def text_list(items, ascii_only=True):
    """JSON list of an array of texts."""
    return json_list(F.transform(items, lambda x: quoted(x, ascii_only)))


def json_object(members, sort=False):
    """JSON object of {name: JSON text column}, in the given order or sorted by name.

    A blank follows every comma and colon, so equal values give equal bytes and hashes.
    """
    names = sorted(members) if sort else list(members)
    parts = []
    for i, name in enumerate(names):
        parts += [F.lit((", " if i else "") + '"' + name + '": '), members[name]]
    return F.concat(F.lit("{"), *parts, F.lit("}"))
