"""Quick text tests give what the plain patterns give."""

import json
import random
import re

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import json as J
from quillgate.functions import redact
from quillgate.functions import text as X
from quillgate.operators import copyguard, web

BITS = [
    "sk-", "AIza", "a" * 13, "b_-" * 6, "0123456789", " ", "\n", "|", "/Users/", "/HOME/", "C:\\Users\\", "x@y.co", "@", "é", "ſ", "K", "_",
    "+31 (0)20-123.45", ".zip", ".TRACE.zip", "trace_", "?token=", "&sig=", "[redacted]", "A" * 31, "A" * 32, "中", "\u2003", "."]
WORDS = [
    "I downloaded", "İ", "ı", "after", "installed", "inſtalled", "INSTALLING", "GitHub", "github", "gıthub", "Kiwi", "kiwi", "x", "a/b", "/",
    "don't", "this's'", "''''", "中文", "\U0001f600", "—", "with", "aaaa"]
SPACES = [" ", " ", " ", "\n", "\t", "\x85", "\u2003", "  "]


def _texts(spark, parts, seed, ends=("",)):
    r = random.Random(seed)
    rows = [("".join(r.choice(parts) + r.choice(ends) for _ in range(r.choice([0, 1, 3, 9, 36, 41]))),) for _ in range(1500)]
    return spark.createDataFrame([*rows, ("",), (None,), ("a" * 100000,), ("a " * 50000,)], "t string")


def _same(df, pairs):
    row = df.select(*[(~a.eqNullSafe(b)).cast("int").alias(n) for n, (a, b) in pairs.items()]).groupBy().sum().first().asDict()
    assert not any(row.values()), row


def test_classes_are_found_as_by_their_patterns(spark):
    t = F.coalesce("t", F.lit(""))
    _same(_texts(spark, BITS, 1), {n: (redact.found(t, n), t.rlike(p)) for n, p in redact.CLASSES.items()})


def test_cells_are_redacted_as_by_plain_replacement(spark):
    t = F.coalesce("t", F.lit(""))
    _same(_texts(spark, BITS, 2), {
        n: (redact.replaced(t, n, p, new), F.regexp_replace(t, p, new)) for n, p, new in redact.STEPS})


def test_more_words_agrees_with_the_count(spark):
    _same(_texts(spark, WORDS, 3, SPACES), {
        f"{n}_{slash}": (X.more_words("t", n, slash), X.word_count("t", slash) > n) for n in (0, 35, 40) for slash in (True, False)})


def test_download_claims_and_brands_in_odd_letters(spark):
    t = X.text("t")
    claims = [r"\bi\s+downloaded\b", r"\bi\s+installed\b", r"\bafter\s+downloading\b", r"\bafter\s+installing\b"]

    def plain_brand(brand):
        rest = F.regexp_replace(t, rf"(?<![A-Za-z0-9])\Q{brand}\E(?![A-Za-z0-9])", "\x00")
        return rest.rlike(rf"(?iu)(?<![A-Za-z0-9])\Q{brand}\E(?![A-Za-z0-9])")

    _same(_texts(spark, WORDS, 4, SPACES), {
        "claim": (copyguard.has_download_claim("t"), X.any_of([t.rlike("(?iU)" + p) for p in claims])),
        "brand": (copyguard.has_non_lowercase_brand("t", F.lit("Kiwi"), F.lit("https://github.com")), plain_brand("kiwi") | plain_brand("github"))})


def test_keywords_keep_their_order_and_lose_trailing_apostrophes(spark):
    def plain(text):
        words = dict.fromkeys(w for w in re.findall(r"[a-z][a-z0-9'-]{3,}", (text or "").lower()) if w not in T.STOPWORDS)
        return list(dict.fromkeys(w for w in (x.rstrip("'") for x in words) if w))

    rows = _texts(spark, ["don't", "this's'", "aaaa", "aaaa'", "with", "x''''", "bbbb-c"], 5, SPACES).select("t", X.keywords("t").alias("k")).collect()
    assert all(r.k == plain(r.t) for r in rows)


def test_json_strings_of_all_characters(spark):
    r = random.Random(6)
    chars = [*map(chr, range(160)), "é", "中", "\U0001f600", "a", "b"]
    texts = [*chars, *["".join(r.choice(chars) for _ in range(r.randint(0, 9))) for _ in range(800)]]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", J.quoted("t").alias("a"), J.quoted("t", False).alias("b")).collect()
    assert all(json.loads(x.a) == x.t == json.loads(x.b) for x in rows)
    assert all(x.a.isascii() and "\x7f" not in x.a for x in rows)


def test_word_limits_do_not_split_whole_lines(spark):
    plan = copyguard.copy_flags(spark.range(1).selectExpr(*[f"cast(id as string) as {c}" for c in [
        "opening_line", "tailored_insight", "used_text", "company_name", "website_url", "evidence_text", "app_evidence_text"]]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "size(split(" not in text


def test_sentences_with_the_list_mark_stay_whole(spark):
    """Sentences were joined and split again at U+001E."""
    metrics = {"viewportHeight": 800.0, "bodyTextLength": 900.0, "ctaCount": 1.0, "ctaAboveFoldCount": 1.0, "primaryCta": {"text": "Get\x1estarted"}}
    row = web.visual_observations(spark.createDataFrame([("mobile", json.dumps(metrics))], "viewport string, metrics string")).first()
    assert row.observations == ["mobile: " + T.VISUAL_NOTES["quiet"].format(cta="Get\x1estarted")]
