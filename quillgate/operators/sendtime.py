"""Send-time advice from region defaults and the open pattern of earlier sends."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.operators.rows import attach_scalar, lookup_join, settle, top_k


def region_from_url(url):
    low, out = F.lower(X.text(url)), None
    for needles, region in T.URL_REGIONS:
        out = F.when(X.has_any(low, needles), region) if out is None else out.when(X.has_any(low, needles), region)
    return out.otherwise("us")


def zone_label(region, match="reference"):
    """Zone label of a region text; ``match='longest'`` tests longer region names first."""
    rules = list(T.REGION_LABELS)
    if match == "longest":
        rules.sort(key=lambda rule: -len(rule[0]))
    low, out = F.lower(X.clean(region)), None
    for needle, label in rules:
        cond = low.contains(needle)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise("generic")


def candidate_hours(zone):
    out = None
    for label, hours in T.BEST_HOURS.items():
        if label != "generic":
            arr = X.lits(hours)
            out = F.when(F.col(zone) == label, arr) if out is None else out.when(F.col(zone) == label, arr)
    return out.otherwise(X.lits(T.BEST_HOURS["generic"]))


def sent_timestamp(c):
    return F.try_to_timestamp(F.regexp_replace(X.text(c), "Z$", "+00:00"))


def hour_pattern(sends, opened_only=False, min_total=50, min_per_hour=3):
    """Open rate per hour of day once there are enough sends.

    ``opened_only=True`` looks at opened sends only, which makes every rate 1.
    """
    df = sends.withColumn("hour", F.hour(sent_timestamp("sent_at")))
    total = sends.agg(F.count(F.lit(1)).alias("__total"))
    rows = df.filter(F.col("hour").isNotNull())
    if opened_only:
        rows = rows.filter("was_opened")
    per_hour = rows.groupBy("hour").agg(
        F.count(F.lit(1)).alias("sends"), F.count_if("was_opened").alias("opens"))
    per_hour = per_hour.filter(F.col("sends") >= min_per_hour)
    return attach_scalar(per_hour, total).filter(F.col("__total") >= min_total).select(
        "hour", "sends", "opens", (F.col("opens").cast("double") / F.col("sends")).alias("open_rate"))


def _pattern_map(pattern):
    """The pattern as a one-row map: at most 24 entries."""
    return pattern.agg(F.map_from_entries(F.collect_list(F.struct("hour", "open_rate"))).alias("__rates"))


def _weight(weekday):
    return F.element_at(X.lits(T.WEEKDAY_WEIGHTS), weekday + 1)


def _best_hour(hours, rates):
    """Struct (rate, turn, hour) of the best candidate; earlier candidates win ties."""
    return F.array_max(F.filter(F.transform(hours, lambda h, i: F.struct(
        F.coalesce(F.element_at(rates, h), F.lit(0.0)).alias("rate"), (-i).alias("turn"), h.alias("hour"))),
        lambda x: x["hour"].isNotNull()))


def advise(leads, pattern, as_of, days_ahead=0, region=None, match="reference"):
    """Best send time per lead for a fixed ``as_of`` time.

    The pattern has at most 24 rows and travels as one broadcast map, so the candidates of
    a lead are compared inside its own row, without a join or a window per lead.
    """
    now = F.lit(as_of).cast("timestamp")
    df = leads.withColumn("__region", F.col(region) if region else region_from_url("website_url"))
    df = df.withColumn("timezone_label", zone_label("__region", match))
    df = df.withColumn("__hours", candidate_hours("timezone_label"))
    df = attach_scalar(df, _pattern_map(pattern))
    known = F.size("__rates") > 0
    ahead = F.lit(days_ahead) if isinstance(days_ahead, int) else F.col(days_ahead)
    first_day = _weight(F.pmod(F.weekday(now) + ahead, F.lit(7)))
    df = df.withColumns({
        "__best": _best_hour(F.col("__hours"), F.col("__rates")),
        "__known": known, "__ahead": ahead,
    })
    hour = F.when(F.col("__known"), F.col("__best.hour")).otherwise(F.get("__hours", F.lit(0)))
    df = df.withColumns({
        "hour_score": F.when(F.col("__known"), F.least(F.col("__best.rate") * first_day * 1.1, F.lit(1.0))).otherwise(0.6),
        "source": F.when(F.col("__known"), "historical").otherwise("regional_default"),
        "__slot": F.date_trunc("day", now) + F.make_dt_interval(F.col("__ahead"), hour),
    })
    late = (F.col("__slot") <= now + F.expr("interval 1 hour")) & (F.col("__ahead") == 0)
    df = df.withColumn("send_at_utc", F.when(late, F.col("__slot") + F.expr("interval 1 day")).otherwise(F.col("__slot")))
    df = df.withColumn("__wd", F.weekday("send_at_utc"))
    df = df.withColumn("weekday_factor", _weight(F.col("__wd")))
    confidence = F.when(F.col("source") == "regional_default", F.col("hour_score") * F.col("weekday_factor")).otherwise(F.col("hour_score"))
    hours_text = F.concat(F.lit("["), F.array_join(F.col("__hours").cast("array<string>"), ", "), F.lit("]"))
    reasoning = F.concat_ws(
        " | ",
        F.concat(F.lit("Tijdzone: "), "timezone_label"),
        F.when(F.col("__known"), "Historische data gebruikt").otherwise("Geen historische data → standaard patroon"),
        F.when(F.col("source") == "historical", F.lit("Data-gedreven uur-selectie")).otherwise(
            F.concat(F.lit("Regio-standaard beste uren: "), hours_text)),
        F.concat(F.lit("Weekdag: "), F.element_at(X.lits(T.WEEKDAY_NAMES), F.col("__wd") + 1),
                 F.lit(" (factor "), F.format_string("%.2f", "weekday_factor"), F.lit(")")),
    )
    df = df.withColumns({"confidence": F.bround(confidence, 2), "reasoning": reasoning})
    df = settle(df, ["send_at_utc", "confidence", "timezone_label", "source"])
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def top_days(leads, pattern, as_of, key, days=4, keep=3):
    """The best three of the next four days per lead, by confidence, then by day.

    Spark keeps at most three options per lead and input task before the shuffle.
    """
    df = leads.withColumn("days_ahead", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    advice = advise(df, pattern, as_of, "days_ahead")
    ranked = top_k(advice, [key], [F.desc("confidence"), F.col("days_ahead")], keep, "option_rank")
    return ranked.select(
        key, "option_rank", "days_ahead", "send_at_utc", "confidence", "timezone_label", "source")


def attach_advice(rows, advice, key="company_name"):
    """Advice of the row's company; rows without a lead get the fixed note."""
    fields = advice.select(
        key,
        F.date_format("send_at_utc", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("suggested_send_time_utc"),
        F.col("timezone_label").alias("suggested_send_timezone"),
        F.col("confidence").alias("send_time_confidence"),
        F.col("source").alias("send_time_source"),
        F.col("reasoning").alias("send_time_reasoning"),
        format_advice().alias("send_time_shown"),
    )
    out = lookup_join(rows, fields, [key])
    return out.withColumns({
        "send_time_reasoning": F.coalesce("send_time_reasoning", F.lit("No matching lead for timezone detection")),
        "send_time_confidence": F.coalesce("send_time_confidence", F.lit(0.0)),
        **{c: X.text(c) for c in ["suggested_send_time_utc", "suggested_send_timezone", "send_time_source", "send_time_shown"]},
    })


def format_advice():
    """2024-01-02 14:00 UTC (US Eastern) - confidence: 57%."""
    return F.concat(
        F.date_format("send_at_utc", "yyyy-MM-dd HH:mm"), F.lit(" UTC ("),
        F.replace("timezone_label", F.lit("_"), F.lit(" ")), F.lit(") — confidence: "),
        F.bround(F.col("confidence") * 100, 0).cast("int"), F.lit("%"))


def mean_confidence(rows):
    return rows.filter(F.col("suggested_send_time_utc") != "").agg(
        F.count(F.lit(1)).alias("timed_rows"),
        F.round(F.avg("send_time_confidence"), 4).alias("mean_confidence"))
