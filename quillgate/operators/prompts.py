"""Prompt and reply tables: rendering, token cost, budget, cache, reply parsing."""

from pyspark.sql import functions as F

from quillgate import terms as T
from quillgate.functions import json as J
from quillgate.functions import text as X
from quillgate.functions.json import parse_object
from quillgate.operators.order import running
from quillgate.operators.reports import price_columns
from quillgate.operators.rows import lookup_join


def render(template, columns):
    """Fill ``{name}`` places of a template column with the named columns."""
    out = X.text(template)
    for name in columns:
        out = F.replace(out, F.lit("{" + name + "}"), X.text(name))
    return out


def with_tokens(prompts, system="system_prompt", user="user_payload"):
    return prompts.withColumn("input_tokens", X.token_estimate(system) + X.token_estimate(user))


def with_cost(rows, model="model_name", input_tokens="input_tokens", output_tokens="output_tokens"):
    price_in, price_out = price_columns(model)
    return rows.withColumns({"input_price": price_in, "output_price": price_out}).withColumn(
        "cost_usd",
        F.col(input_tokens) / F.lit(1e6) * F.col("input_price") + F.col(output_tokens) / F.lit(1e6) * F.col("output_price"))


def admit(rows, max_calls=0, max_cost=0.0, input_price=0.10, output_price=0.40, order="row_idx"):
    """Calls admitted under a call limit and a cost limit, in the order of a unique number, gaps allowed.

    Before each call the cost of everything so far plus this input and a fixed output
    reserve must stay inside the limit.  A batch stops at its first refused call: tokens are
    never negative (null and negative counts are 0), so costs grow and all later calls are refused as well.
    """
    if not max_calls and not max_cost:
        return rows
    tokens = {n: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0)) for n, c in (("__in", "input_tokens"), ("__out", "output_tokens"))}
    df = running(rows, order, sums={**tokens, "__calls": F.lit(1)})
    projected = F.col("__in") / F.lit(1e6) * F.lit(float(input_price)) + (
        F.col("__out") - tokens["__out"] + T.RESERVED_OUTPUT_TOKENS) / F.lit(1e6) * F.lit(float(output_price))
    df = df.withColumn("projected_cost", projected)
    if max_calls:
        df = df.filter(F.col("__calls") <= max_calls)
    if max_cost:
        df = df.filter(F.col("projected_cost") <= max_cost)
    return df.drop("__in", "__out", "__calls")


def response_key(provider="provider", model="model_name", temperature="temperature",
                 system="system_prompt", user="user_payload"):
    return F.sha2(F.concat_ws(":", *[X.text(c) for c in (provider, model, temperature, system, user)]), 256)


def page_key(url="url", prefix=""):
    return F.sha2(F.concat(F.lit(prefix), X.text(url)), 256)


def fresh(cache, as_of_epoch, ttl_seconds=86400):
    """Cache rows that are not expired; rows without a time stamp count as valid."""
    return cache.filter(F.col("cached_at").isNull() | (F.lit(float(as_of_epoch)) - F.col("cached_at") <= ttl_seconds))


def cache_split(calls, cache, as_of_epoch, ttl_seconds=86400, key="cache_key"):
    """(hits with their stored reply, misses)."""
    valid = fresh(cache, as_of_epoch, ttl_seconds).select(key, "reply", F.lit(True).alias("__hit"))
    joined = lookup_join(calls, valid, [key])
    hits = joined.filter(F.col("__hit")).drop("__hit")
    return hits, joined.filter(F.col("__hit").isNull()).drop("__hit", "reply")


def expired_count(cache, as_of_epoch, ttl_seconds=86400):
    old = F.lit(float(as_of_epoch)) - F.col("cached_at") > ttl_seconds
    return cache.agg(F.count_if(F.coalesce(old, F.lit(False))).alias("removed"), F.count(F.lit(1)).alias("rows"))


def usage(calls):
    """Calls and estimated tokens."""
    return calls.agg(
        F.count(F.lit(1)).alias("llm_calls"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("estimated_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).alias("estimated_output_tokens"))


DRAFT_SCHEMA = "opening_line string, tailored_insight string, chosen_angle string, evidence_used_for_copy array<string>"
JUDGE_SCHEMA = (
    "decision string, evidence_score string, copy_quality_score string, outcome_alignment_score string, "
    "template_fit_score string, surface_correctness_score string, reasons array<string>, preferred_rewrite string"
)
QC_SCHEMA = "score int, `pass` boolean, reasons array<string>, quality_flags array<string>"


def _tidy(arr):
    """Trimmed, non-blank items of a reply list."""
    kept = F.filter(F.transform(F.array_compact(arr), X.strip), lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def parse_drafts(replies, reply="reply", keep=("lead_id",)):
    """Draft fields of a reply; replies without a JSON object keep a failure flag."""
    df = replies.select(*keep, parse_object(reply, DRAFT_SCHEMA).alias("r"))
    return df.select(
        *keep, *[X.clean(f"r.{c}").alias(c) for c in ("opening_line", "tailored_insight", "chosen_angle")],
        _tidy("r.evidence_used_for_copy").alias("evidence_used_for_copy"),
        F.col("r").isNull().alias("reply_failed"))


def parse_judgements(replies, reply="reply", keep=("example_id", "model")):
    df = replies.select(*keep, parse_object(reply, JUDGE_SCHEMA).alias("r"))
    decision = F.lower(X.clean("r.decision"))
    scores = ["evidence_score", "copy_quality_score", "outcome_alignment_score", "template_fit_score", "surface_correctness_score"]
    return df.select(
        *keep,
        F.when(F.col("r").isNull(), "error").when(decision.isin("send", "edit", "reject"), decision).otherwise("unknown").alias("judge_decision"),
        *[X.text(f"r.{c}").alias(f"judge_{c}") for c in scores],
        X.join_list(_tidy("r.reasons")).alias("judge_reasons"),
        X.text("r.preferred_rewrite").alias("judge_preferred_rewrite"))


def parse_qc(replies, reply="reply", keep=("lead_id", "variant", "iteration")):
    df = replies.select(*keep, parse_object(reply, QC_SCHEMA).alias("r"))
    return df.select(
        *keep, F.coalesce("r.score", F.lit(0)).alias("model_score"),
        F.coalesce(F.col("r.pass"), F.lit(False)).alias("model_pass"),
        _tidy("r.quality_flags").alias("model_flags"), _tidy("r.reasons").alias("qc_reasons"))


# --- payloads ---------------------------------------------------------------------------------
_FACT_MEMBERS = {
    "fact": "text", "why_it_matters": "text", "source_url": "text", "strength": "text", "too_generic_to_use": "truth",
    "friction_type": "text", "surface_checked": "text", "conversion_outcome": "text", "angle_priority": "number",
    "blog_used": "truth", "why_this_angle": "text"}
_PROFILE_TEXTS = ["name", "description", "opening_style", "custom_prompt"]
_PROFILE_LISTS = [
    "angle_priorities", "preferred_phrases", "banned_phrases", "qc_focus", "example_good_lines", "example_bad_lines"]


def fact_json(ascii_only=True):
    """JSON object of one fact row, members in their fixed order."""
    make = {"text": lambda c: J.quoted(c, ascii_only), "truth": J.truth, "number": J.number}
    return J.json_object({c: make[kind](c) for c, kind in _FACT_MEMBERS.items()})


def evidence_json(facts, key="lead_id", order="fact_pos"):
    """(key, evidence_json): the facts of a lead as one JSON list, in order."""
    rows = facts.select(key, F.struct(F.col(order).alias("at"), fact_json().alias("json")).alias("f"))
    return rows.groupBy(key).agg(J.json_list(F.sort_array(F.collect_list("f"))["json"]).alias("evidence_json"))


def profile_json(sort=False, ascii_only=True):
    """JSON object of a tone-profile row."""
    members = {c: J.quoted(c, ascii_only) for c in _PROFILE_TEXTS}
    members |= {c: J.text_list(c, ascii_only) for c in _PROFILE_LISTS}
    return J.json_object(members, sort)


def profile_hash():
    """Version hash of a tone profile: of its JSON object with sorted names and plain characters."""
    return F.sha2(profile_json(sort=True, ascii_only=False).cast("binary"), 256)
