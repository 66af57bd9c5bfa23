"""URL helpers as Column expressions."""

from pyspark.sql import functions as F

from quillgate.functions.text import clean, col, text

_PARTS = r"^(https?)://([^/?#]*)([^?#]*)"


def scheme(url):
    return F.regexp_extract(text(url), _PARTS, 1)


def netloc(url):
    """Lower-case host part."""
    return F.lower(F.regexp_extract(text(url), _PARTS, 2))


def path(url):
    return F.regexp_extract(text(url), _PARTS, 3)


def host(url):
    """Lower-case host without a leading www."""
    return F.regexp_replace(netloc(url), r"^www\.", "")


def with_scheme(url):
    """https:// in front of a non-blank URL without a scheme."""
    return F.regexp_replace(clean(url), r"^(?!https?://)(?=(?s:.))", "https://")


def normalize(url):
    """Scheme added, host lower without www., no query, fragment or trailing slash.

    Text without a host part is returned as it is (blank or broken).
    """
    raw = with_scheme(url)
    tidy = F.regexp_replace(raw, r"^(https?://[^/?#]+)([^?#]*?)/*(?:[?#].*)?$", "$1$2")
    start = F.regexp_extract(tidy, r"^https?://[^/?#]*", 0)
    return F.concat(F.regexp_replace(F.lower(start), r"^(https?://)www\.", "$1"),
                    F.regexp_replace(tidy, r"^https?://[^/?#]*", ""))


def strip_query(url):
    """URL without query, fragment and trailing slashes."""
    return F.regexp_replace(F.regexp_replace(text(url), r"[?#].*$", ""), "/+$", "")


def company_from_host(url):
    """acme-labs.io -> Acme Labs."""
    stem = F.split_part(host(url), F.lit("."), F.lit(1))
    words = F.regexp_replace(F.trim(F.translate(stem, "-_", "  ")), " +", " ")
    return F.initcap(words)


def same_host(a, b):
    return host(a) == host(b)


def join(base, href):
    """Absolute form of a link: scheme-relative, root-relative, absolute or relative."""
    base, href = col(base), clean(href)
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(text(base), _PARTS, 2))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(text(base), r"[?#].*$", ""), href))
        .otherwise(F.concat(root, folder, href))
    )
