"""Constants whose value decides whether results are right."""

# --- fixed values -----------------------------------------------------------

# Image likelihood names and their 0-100 scores; any other name scores 55.
LIKELIHOOD_SCORE = {
    "VERY_UNLIKELY": 10,
    "UNLIKELY": 30,
    "POSSIBLE": 60,
    "LIKELY": 80,
    "VERY_LIKELY": 95,
    "UNKNOWN": 55,
}
LIKELIHOOD_DEFAULT = 55

# Highest score that still passes, highest that still goes to review.
PASS_MAX = 50
REVIEW_MAX = 70

# How long a video frame of unknown duration counts, in milliseconds.
FRAME_MS = 100

# Image types that are scored.
IMAGE_MIME_TYPES = ("image/jpeg", "image/bmp", "image/gif", "image/png")

ACTIONS = ("pass", "review", "block")
SEVERITIES = ("low", "medium", "high", "critical")

# Highest score of each confidence band but the last.
BANDS = ((39, "weak"), (69, "mixed"), (89, "strong"))
TOP_BAND = "multi_source"

TEXT_FLAGGED = ("true_positive", "flagged_fallback")
DISPOSITIONS = ("true_positive", "false_positive", "inconclusive")

RETENTION_DAYS = {
    "demo_24h": 1,
    "demo_7d": 7,
    "demo_90d": 90,
    "standard_7y": 2555,
    "legal_hold": 2555,
}

ZERO_HASH = "0" * 64
MANIFEST_VERSION = 1
SIGNATURE_FIELDS = ("signature_alg", "signature", "signing_key_id")
COLLECTION_METHODS = ("api", "export", "kql", "spl", "manual")

SPACE_TYPES = ("SPACE", "GROUP_CHAT")
MESSAGE_CREATED = "google.workspace.chat.message.v1.created"
TREE_ROOTS = ("bookmark_bar", "other", "synced")
LOOKBACK_HOURS = 24

COST_MISSED = 420.0
COST_FALSE_ALARM = 6.0
CURVE_DAYS = 30.0
REVIEW_CAPACITY = 200.0
QUEUE_MIN_PROBABILITY = 0.3
EVASION_SHARE = 0.30
PSI_ALARM = 0.2
PSI_WATCH = 0.1

TOMBSTONE = "[message taken down by content moderation]"

# What evidence rows of a moderated message carry; parts of them are hashed.
EVIDENCE = {
    "source_system": "chat_moderation",
    "collection_method": "api",
    "collector_principal": "content_moderation_pipeline",
    "original_tz": "UTC",
    "pii_tags": ("PII:sender_email",),
    "retention_class": "moderation_evidence",
    "signing_key_id": "moderation_pipeline_v1",
    "manifest_version": 1,
    "uri": "moderation://",
    "text_query": "chat_moderation:text:",
    "image_query": "chat_moderation:image:",
}
# -----------------------------------------------------------------------------
