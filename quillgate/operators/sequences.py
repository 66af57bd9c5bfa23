"""Follow-up sequences: step grid, unused evidence, reply checks, status."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import text as X
from quillgate.functions.json import parse_object
from quillgate.functions.stats import clamp

STEP_SCHEMA = (
    "follow_up_type string, chosen_angle string, opening_line string, body_text string, "
    "cta_text string, evidence_used_for_copy array<string>"
)
MAX_STEPS = 4


def eligible(df):
    return df.filter((F.col("send_confidence") == "send") & (F.col("research_depth") >= 0.6))


def step_grid(leads, max_steps=MAX_STEPS):
    """Leads times steps 1..min(max_steps, 4) with the strategy of each step."""
    last = min(max_steps, MAX_STEPS)
    steps = F.array(*[
        F.struct(F.lit(i + 1).alias("step_number"), F.lit(T.STEP_STRATEGIES[i]).alias("step_strategy"))
        for i in range(last)
    ])
    grid = leads.withColumn("__s", F.explode(steps)).select("*", "__s.*").drop("__s")
    return grid.withColumns({
        "total_steps": F.lit(MAX_STEPS),
        "reply_status": F.when(F.col("step_number") < 4, "has not replied").otherwise(
            "no reply after previous follow-ups"),
    })


def unused_evidence(all_evidence, used, count=3):
    """The first items that the original mail did not use (repeats stay)."""
    rest = F.filter(all_evidence, lambda e: ~F.array_contains(used, e))
    return F.slice(rest, 1, count)


def parse_steps(replies, reply="reply", keep=("lead_id", "step_number")):
    parsed = replies.select(*keep, parse_object(reply, STEP_SCHEMA).alias("r"))
    return parsed.select(*keep, "r.*", F.col("r").isNull().alias("reply_failed"))


def check_steps(steps, key="lead_id", repeated=True):
    """Clean the reply fields, flag and score every step.

    Steps after the first break-up step, or beyond step four, do not exist in a sequence.
    They are cut first; what is left of a lead is at most four rows, which is what the
    look-back over earlier angles works on.
    """
    kind = F.lower(X.clean("follow_up_type"))
    df = steps.withColumns({
        "follow_up_type": F.when(kind.isin(T.FOLLOW_UP_TYPES), kind).otherwise("value"),
        **{c: X.clean(c) for c in ["chosen_angle", "opening_line", "body_text", "cta_text"]},
    })
    df = df.filter(F.col("step_number") <= MAX_STEPS)
    lead = W.partitionBy(key)
    stop = F.min(F.when(F.col("follow_up_type") == "breakup", F.col("step_number"))).over(lead)
    df = df.withColumn("__stop", stop).filter(
        F.col("__stop").isNull() | (F.col("step_number") <= F.col("__stop"))).drop("__stop")
    angle_key = F.lower(X.strip(X.before("chosen_angle", ":")))
    df = df.withColumn("angle_key", F.when(F.col("chosen_angle") != "", angle_key))
    earlier = lead.orderBy("step_number").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("__earlier", F.collect_list("angle_key").over(earlier))
    again = F.exists("__earlier", lambda a: F.col("angle_key").contains(a) | a.contains(F.col("angle_key")))
    breakup = F.col("follow_up_type") == "breakup"
    spoken = F.lower(F.concat_ws(" ", "opening_line", "body_text"))
    conditions = {
        "missing_angle": F.col("chosen_angle") == "",
        "missing_opening_line": F.col("opening_line") == "",
        "missing_body_text": F.col("body_text") == "",
        "missing_cta": (F.col("cta_text") == "") & ~breakup,
        "repeated_angle": F.coalesce(again, F.lit(False)),
        "opening_too_short": (F.col("opening_line") != "") & (F.length("opening_line") < 20),
        "body_too_short": (F.col("body_text") != "") & (F.length("body_text") < 30),
        "generic_followup_language": ~breakup & X.has_any(spoken, T.GENERIC_FOLLOW_UPS),
    }
    df = df.withColumn("quality_flags", X.flags(*[(c, n) for n, c in conditions.items()])).drop("__earlier")
    penalty = sum(
        (F.when(F.array_contains("quality_flags", n), F.lit(p)).otherwise(F.lit(0.0)) for n, p in T.FOLLOW_UP_PENALTIES),
        F.lit(0.0),
    )
    raw = F.lit(8.0) - penalty
    review = [n for n in conditions if n not in ("opening_too_short", "body_too_short")]
    return df.withColumns({
        "quality_score": clamp(raw, 0.0, 10.0),
        "needs_review": X.overlaps(F.col("quality_flags"), review) | (raw < 7),
    })


def minimum_score(steps, minimum):
    return steps.filter(F.col("quality_score") >= minimum)


def sequence_status(checked, key="lead_id"):
    """Mean of the positive step scores and the status of each sequence."""
    return checked.groupBy(key).agg(
        F.count(F.lit(1)).alias("steps"),
        F.coalesce(F.bround(F.avg(F.when(F.col("quality_score") > 0, F.col("quality_score"))), 1), F.lit(0.0))
        .alias("overall_quality_score"),
        F.bool_or("needs_review").alias("needs_review"),
    ).withColumn("sequence_status", F.when(F.col("needs_review"), "needs_review").otherwise("qc_passed"))


def sequence_rows(base, checked, key="lead_id"):
    """One export row per step on top of the base row."""
    steps = checked.select(
        key, F.col("step_number").alias("sequence_step"), "follow_up_type",
        *[F.col(c).alias(f"sequence_{c}") for c in ["opening_line", "body_text", "cta_text", "chosen_angle"]],
        X.join_list("evidence_used_for_copy").alias("sequence_evidence_used"),
        F.col("quality_score").alias("sequence_quality_score"),
        X.join_list("quality_flags").alias("sequence_quality_flags"),
        F.col("needs_review").alias("sequence_needs_review"),
    )
    return base.join(steps, key)
