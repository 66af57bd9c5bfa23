"""A/B experiments: assignment, results, significance and report."""

import math

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import stats as S
from quillgate.functions import text as X
from quillgate.operators.rows import lookup_join, upsert

VARIANT_SCHEMA = "array<struct<variant_id:string,label:string,description:string>>"


def register(registry, new):
    """Insert or replace experiments by id (creation time is replaced as well)."""
    return upsert(registry.drop("created_at"), new.drop("created_at"), ["experiment_id"], None, ["updated_at"]).withColumn(
        "created_at", F.col("updated_at"))


def active(registry):
    return registry.filter("enabled")


def variants_of(registry):
    """One row per variant with its position."""
    parsed = registry.withColumn("__v", F.from_json("variants_json", VARIANT_SCHEMA))
    return parsed.select("experiment_id", F.posexplode("__v").alias("variant_pos", "v")).select(
        "experiment_id", "variant_pos", "v.variant_id", "v.label", X.text("v.description").alias("description"))


def lead_hash(experiment="experiment_id", lead="lead_id"):
    return F.md5(F.concat(X.text(experiment), F.lit(":"), X.text(lead)))


def assign_hash(leads, variants):
    """Same lead, same variant: first eight md5 digits modulo the number of variants."""
    key = F.concat(X.text("experiment_id"), F.lit(":"), X.text("lead_id"))
    index = X.bucket_of(key, len(variants)).cast("int")
    return leads.withColumns({
        "lead_hash": lead_hash(), "variant_id": F.element_at(X.lits(variants), index + 1)})


def uniform(seed, *parts):
    """Repeatable number between 0 and 1 from the md5 of the parts: its first 13 hex digits, in the middle of their cell."""
    return _digits(F.md5(F.concat_ws(":", *[X.text(p) for p in parts], F.lit(str(seed)))), 1, 13)


def _digits(digest, first, count):
    """The number between 0 and 1 that some hex digits name."""
    return (F.conv(F.substring(digest, first, count), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** count))


def assign_fixed(leads, weights, seed=0):
    """Draw by fixed weights with a hash-derived uniform; no weights give null."""
    if not weights:
        return leads.withColumn("variant_id", F.lit(None).cast("string"))
    total, running, pick = float(sum(weights.values())), 0.0, None
    u = F.col("__u")
    for name, weight in weights.items():
        running += weight
        cond = u < F.lit(running / total)
        pick = F.when(cond, name) if pick is None else pick.when(cond, name)
    out = leads.withColumn("__u", uniform(seed, "experiment_id", "lead_id"))
    return out.withColumn("variant_id", pick.otherwise(F.lit(list(weights)[-1]))).drop("__u")


def posteriors(results):
    """Beta posterior of every variant."""
    return results.withColumns({
        "alpha": (F.lit(1) + F.col("converted")).cast("double"),
        "beta": (F.lit(1) + F.col("total") - F.col("converted")).cast("double"),
    }).withColumns({
        "mean": F.col("alpha") / (F.col("alpha") + F.col("beta")),
        "samples": F.col("alpha") + F.col("beta") - 2,
    })


#: Tries of one gamma draw: each is refused with a probability below 0.05, all of them with one below 1e-13.
TRIES = 10


def gamma_draw(shape, *parts):
    """A gamma-distributed number of a shape of 1 or more: cubed normals, refused and tried again (Marsaglia and Tsang).

    Normals and refusals come from the md5 of the parts and the number of the try, so a draw is repeatable and
    costs the same at any shape.  Should every try be refused, the draw is the middle of the distribution.
    """
    d = shape - 1.0 / 3.0
    # each step binds its numbers to the items of an array, so no expression is written out twice
    hashes = F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda i: F.md5(F.concat_ws(":", *parts, i.cast("string"))))
    tries = F.transform(hashes, lambda h: F.struct(
        (F.sqrt(-2.0 * F.log(_digits(h, 1, 11))) * F.cos(2.0 * math.pi * _digits(h, 12, 11))).alias("normal"),
        F.log(_digits(h, 23, 10)).alias("refusal")))
    bases = F.transform(tries, lambda t: F.struct((1.0 + t["normal"] / F.sqrt(9.0 * d)).alias("base"), t["normal"].alias("normal"), t["refusal"].alias("refusal")))
    cubes = F.transform(bases, lambda t: F.struct(
        t["base"].alias("base"), (t["base"] * t["base"] * t["base"]).alias("cube"), t["normal"].alias("normal"), t["refusal"].alias("refusal")))
    taken = F.filter(cubes, lambda t: (t["base"] > 0) & (
        t["refusal"] < 0.5 * t["normal"] * t["normal"] + d - d * t["cube"] + d * F.log(t["cube"])))
    return F.coalesce(d * F.get(taken, F.lit(0))["cube"], d)


def beta_draw(alpha, beta, *parts):
    """A beta-distributed number, as a share of two gamma draws."""
    a, b = gamma_draw(alpha, *parts, F.lit("a")), gamma_draw(beta, *parts, F.lit("b"))
    return a / (a + b)


def assign_thompson(leads, results, variants, seed=0):
    """Thompson sampling from one posterior snapshot; draws are seeded by experiment, lead and variant.

    Per experiment the posteriors form one small row (one entry per variant), which is
    joined to the leads; the draws of a lead are compared inside its row.
    """
    stats = posteriors(results).filter(F.col("variant_id").isin(variants))

    def collected(name, variant):
        return F.coalesce(F.max(F.when(F.col("variant_id") == variant, F.col(name))), F.lit(1.0))

    numbers = range(len(variants))
    snapshot = stats.groupBy("experiment_id").agg(
        *[collected("alpha", variants[i]).alias(f"__a{i}") for i in numbers], *[collected("beta", variants[i]).alias(f"__b{i}") for i in numbers])
    df = lookup_join(leads, snapshot, ["experiment_id"])
    one = lambda c: F.coalesce(F.col(c), F.lit(1.0))
    for i in numbers:
        df = df.withColumn(f"__d{i}", beta_draw(
            one(f"__a{i}"), one(f"__b{i}"), X.text("experiment_id"), X.text("lead_id"), F.lit(variants[i]), F.lit(str(seed))))
    draws = F.array(*[F.col(f"__d{i}") for i in numbers])
    best = F.array_position(draws, F.array_max(draws)).cast("int")
    return df.withColumn("variant_id", F.element_at(X.lits(variants), best)).drop(*[f"__{x}{i}" for x in "abd" for i in numbers])


def assign(leads, existing, strategy, variants, weights=None, results=None, labels=None, seed=0):
    """Sticky assignment: leads that have a variant keep it, the others get one by strategy."""
    keys = ["experiment_id", "lead_id"]
    kept = leads.join(existing.select(*keys, "variant_id"), keys)
    fresh = leads.join(existing.select(*keys), keys, "left_anti")
    if strategy == "fixed":
        fresh = assign_fixed(fresh, weights, seed)
    elif strategy == "thompson":
        fresh = assign_thompson(fresh, results, variants, seed)
    else:
        fresh = assign_hash(fresh, variants)
    columns = [*leads.columns, "variant_id"]
    both = kept.select(*columns, F.lit(False).alias("is_new")).unionByName(
        fresh.select(*columns, F.lit(True).alias("is_new")).filter(F.col("variant_id").isNotNull()))
    both = both.withColumn("lead_hash", lead_hash())
    name = X.lookup("variant_id", labels, F.col("variant_id")) if labels else F.col("variant_id")
    return both.withColumn("variant_label", name)


def record_results(old, new):
    """Results by (experiment, variant, lead); a repeat replaces the earlier row."""
    return upsert(old, new, ["experiment_id", "variant_id", "lead_id"], None, ["recorded_at"])


def variant_results(results):
    """Counts and rates per variant."""
    df = results.groupBy("experiment_id", "variant_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("was_opened").alias("opened"),
        F.count_if("got_reply").alias("replied"),
        F.count_if("converted").alias("converted"),
    )
    return df.withColumns({
        f"{name}_rate": S.rate_pct(F.col(c), F.col("total"))
        for name, c in [("open", "opened"), ("reply", "replied"), ("conversion", "converted")]})


def significance(results, min_sample=30, level=0.05, control=None):
    """Every variant of an experiment against its control.

    The control is given or the smallest variant id.  Control rows number one per
    experiment; Spark picks the join strategy from their size.
    """
    first = F.min(F.lit(control)) if control else F.min("variant_id")
    names = results.groupBy("experiment_id").agg(first.alias("variant_id"))
    base = results.join(names, ["experiment_id", "variant_id"]).select(
        "experiment_id", F.col("variant_id").alias("control_id"),
        F.col("total").alias("control_total"), F.col("converted").alias("control_converted"))
    df = results.join(base, "experiment_id")
    is_control = F.col("variant_id") == F.col("control_id")
    tested = ~is_control & (F.col("total") >= min_sample) & (F.col("control_total") >= min_sample)
    df = df.withColumn("__chi2", S.chi_square(
        F.col("control_converted"), F.col("control_total"), F.col("converted"), F.col("total")))
    low, high = S.wilson(F.col("converted"), F.col("total"))
    better = F.col("converted").cast("double") / F.col("total") > F.col("control_converted").cast("double") / F.col("control_total")
    df = df.withColumns({
        "__p": F.when(tested, S.p_value(F.col("__chi2"))),
        "p_value_two_sided": F.when(tested, F.bround(S.p_value(F.col("__chi2"), two_sided=True), 4)),
        "ci_low": F.bround(low * 100, 1), "ci_high": F.bround(high * 100, 1),
        "enough_data": F.col("total") >= min_sample, "is_control": is_control,
    })
    return df.withColumns({
        "p_value": F.bround("__p", 4),
        "significant_winner": F.coalesce((F.col("__p") < level) & better, F.lit(False)),
    }).drop("__chi2", "__p", "control_total", "control_converted")


def wilson_intervals(results):
    low, high = S.wilson(F.col("converted"), F.col("total"))
    return results.withColumns({"ci_low": F.bround(low * 100, 1), "ci_high": F.bround(high * 100, 1)})


def _short(c):
    """A number of four decimals without the zeros at its end, as text."""
    return F.regexp_replace(F.format_string("%.4f", c), r"(\.\d+?)0+$", "$1")


def report(analysed, min_sample=30, labels=None):
    """Status, winner, p and recommendation per experiment.

    With fewer than two variants an experiment is still running.
    """
    label = X.lookup("variant_id", labels, F.col("variant_id")) if labels else F.col("variant_id")
    df = analysed.withColumn("__label", label)
    row = F.struct(F.col("variant_id").alias("id"), F.col("__label").alias("label"), "conversion_rate", "p_value")
    # ties go to the variant that comes first
    def best(cond=None):
        rank = F.struct((-F.col("conversion_rate")).alias("r"), F.col("variant_id"))
        return F.min_by(row, F.when(cond, rank) if cond is not None else rank)

    agg = df.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("variants"), F.sum("total").alias("total_leads"),
        F.bool_and("enough_data").alias("__all"), F.bool_or("significant_winner").alias("__any"),
        best().alias("__best"), best(F.col("significant_winner")).alias("__win"),
        F.min_by("p_value", F.when(F.col("significant_winner"), F.col("variant_id"))).alias("__p"),
    )
    few = F.col("variants") < 2
    status = F.when(few, "running").when(F.col("__any"), "significant").when(F.col("__all"), "inconclusive").otherwise("running")
    winner = F.when(~few, F.coalesce("__win", "__best"))
    out = agg.withColumns({"status": status, "__w": winner})
    say = lambda name: X.filled(T.EXPERIMENT_ADVICE[name], {
        "label": F.col("__w.label"), "rate": F.col("__w.conversion_rate"), "p": _short(F.col("__w.p_value")), "n": F.lit(min_sample)})
    advice = F.when(few, say("few_variants")).when(F.col("status") == "significant", say("significant")).when(
        F.col("status") == "inconclusive", say("inconclusive")).otherwise(say("running"))
    return out.select(
        "experiment_id", "variants", "total_leads", "status",
        F.col("__w.id").alias("winner_variant_id"),
        (~few & F.col("__any")).alias("is_significant"),
        F.when(~few, F.col("__p")).alias("p_value"), advice.alias("recommendation"))
