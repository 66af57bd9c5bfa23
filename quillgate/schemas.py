"""Declared table schemas (DDL strings)."""

SENDS = (
    "run_id string, row_id string, example_id string, company_name string, recipient_name string, "
    "recipient_role string, website_url string, opening_line string, tailored_insight string, "
    "chosen_angle string, friction_type string, conversion_outcome string, surface_checked string, "
    "was_opened boolean, got_reply boolean, reply_text string, converted boolean, "
    "conversion_type string, conversion_notes string, time_to_reply_minutes int, sent_at string, "
    "reviewed_at string, created_at string, updated_at string"
)
SEND_RESULTS = (
    "run_id string, row_id string, example_id string, was_opened boolean, got_reply boolean, reply_text string, "
    "converted boolean, conversion_type string, conversion_notes string, "
    "time_to_reply_minutes int, reviewed_at string"
)
EXPERIMENTS = (
    "experiment_id string, name string, variants_json string, allocation_strategy string, "
    "min_sample_size int, significance_level double, max_total int, enabled boolean, "
    "created_at string, updated_at string"
)
ASSIGNMENTS = (
    "experiment_id string, lead_id string, variant_id string, variant_label string, "
    "lead_hash string, assigned_at string"
)
EXPERIMENT_RESULTS = (
    "experiment_id string, variant_id string, lead_id string, was_opened boolean, "
    "got_reply boolean, converted boolean, recorded_at string"
)
RUN_HISTORY = "id bigint, created_at string, payload_json string"
MANIFEST = "name string, version int, description string, files array<struct<path:string,sha256:string,rows:int>>"
TONE_PROFILE = (
    "name string, description string, opening_style string, custom_prompt string, "
    "angle_priorities array<string>, preferred_phrases array<string>, banned_phrases array<string>, "
    "qc_focus array<string>, example_good_lines array<string>, example_bad_lines array<string>"
)
WORKSPACE = (
    "client_id string, display_name string, tone_profile string, default_campaign_context string, "
    "default_research_region string, default_export_preset string, notes string, "
    "created_at string, updated_at string"
)
