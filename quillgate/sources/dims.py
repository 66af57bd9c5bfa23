"""Small dimension tables: tone profiles (full rows from the user's own tables) and client workspaces."""

from pyspark.sql import functions as F

from quillgate import schemas
from quillgate.functions import text as X
from quillgate.operators.rows import first_per_key, lookup_join, upsert

_LISTS = [
    "angle_priorities", "preferred_phrases", "banned_phrases", "qc_focus", "example_good_lines",
    "example_bad_lines",
]


def read_profiles(spark, pattern):
    """Profile files; a single text counts as a one-item list, the file name as the name."""
    loose = schemas.TONE_PROFILE.replace("array<string>", "string")
    df = spark.read.schema(loose).option("multiLine", True).json(pattern)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)

    def as_list(c):
        items = F.from_json(F.col(c), "array<string>")
        return F.when(F.ltrim(X.text(c)).startswith("["), X.split_list(F.array_join(items, X.SEP), X.SEP)).otherwise(
            X.array_of(F.nullif(X.clean(c), F.lit(""))))

    return df.select(
        X.first_present("name", stem).alias("name"),
        *[X.clean(c).alias(c) for c in ("description", "opening_style", "custom_prompt")],
        *[as_list(c).alias(c) for c in _LISTS])


def profile_dimension(*sources):
    """One profile per name; earlier sources win."""
    ranked = None
    for priority, df in enumerate(sources):
        part = df.withColumn("priority", F.lit(priority))
        ranked = part if ranked is None else ranked.unionByName(part)
    return first_per_key(ranked, ["name"], "priority")


def profile_names(*sources):
    """Sorted distinct names over all sources."""
    names = None
    for df in sources:
        part = df.select("name")
        names = part if names is None else names.union(part)
    return names.distinct().orderBy("name")


def with_profile(rows, profiles, column="tone_profile", fallback="friction_first"):
    """Profile name that really exists for each row, the fallback otherwise."""
    dim = profiles.select(F.col("name").alias(column), F.lit(True).alias("__known"))
    joined = lookup_join(rows.withColumn(column, X.first_present(column, F.lit(fallback))), dim, [column])
    return joined.withColumn(
        "resolved_profile", F.when(F.col("__known"), F.col(column)).otherwise(F.lit(fallback))).drop("__known")


def workspace_defaults(df):
    """Workspace rows with their field defaults."""
    return df.select(
        X.first_present("client_id").alias("client_id"),
        X.first_present("display_name", "client_id").alias("display_name"),
        X.first_present("tone_profile", F.lit("friction_first")).alias("tone_profile"),
        X.text("default_campaign_context").alias("default_campaign_context"),
        X.first_present("default_research_region", F.lit("us")).alias("default_research_region"),
        X.first_present("default_export_preset", F.lit("generic")).alias("default_export_preset"),
        *[X.text(c).alias(c) for c in ("notes", "created_at", "updated_at")])


def read_workspaces(spark, pattern):
    df = spark.read.schema(schemas.WORKSPACE).option("multiLine", True).json(pattern)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    df = df.withColumn("client_id", X.first_present("client_id", folder))
    return workspace_defaults(df).orderBy("client_id")


def save_workspaces(existing, new, now):
    """Upsert by slug; the first creation time stays."""
    fresh = new.withColumns({
        "client_id": X.slug(X.first_present("client_id", "display_name")),
        "created_at": F.coalesce(X.blank_to_null("created_at"), F.lit(now)),
        "updated_at": F.lit(now),
    })
    return upsert(existing, workspace_defaults(fresh), ["client_id"], "created_at", ["updated_at"])
