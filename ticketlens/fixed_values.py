"""Word lists, constants and wordings that results must carry exactly.

Every job takes these as parameters with these defaults, so other domains can
pass their own.
"""

# Ticket contract ------------------------------------------------

TICKET_COLUMNS = (
    "ticket_id",
    "created_at",
    "category",
    "description",
    "resolution_minutes",
    "escalated",
    "channel",
    "customer_tier",
)

# Cell texts that a delimited-text reader with default settings takes as missing.
NULL_MARKERS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")

DEFAULT_DEMO_STATUS = "Preloaded fictional demo"
DEFAULT_TICKET_COUNT = 3000

# Category factors (category, repetitiveness, process consistency)

PROCESS_FACTORS = (
    ("order status", 1.00, 1.00),
    ("billing question", 0.65, 0.75),
    ("return request", 0.75, 0.75),
    ("account access", 0.95, 0.95),
    ("damaged shipment", 0.35, 0.40),
    ("product question", 0.50, 0.55),
    ("miscellaneous", 0.10, 0.20),
    ("appointment scheduling", 0.95, 0.95),
    ("insurance eligibility", 0.72, 0.68),
    ("portal access", 1.00, 0.95),
    ("referral status", 0.72, 0.70),
    ("prescription refill request", 0.72, 0.35),
    ("medical records request", 0.72, 0.82),
    ("general inquiry", 0.10, 0.18),
    ("order tracking", 1.00, 1.00),
    ("refund status", 0.92, 0.90),
    ("promotion question", 0.32, 0.30),
    ("subscription change", 0.70, 0.72),
    ("fraud review", 0.18, 0.22),
)

# Score weights and bounds

SCORE_WEIGHTS = {
    "volume_weight": 0.30,
    "repetitiveness_weight": 0.25,
    "handling_time_weight": 0.15,
    "escalation_weight": 0.15,
    "process_consistency_weight": 0.15,
}
FULL_HANDLING_MINUTES = 90

SCORE_BANDS = (
    (75, "Strong opportunity"),
    (55, "Moderate opportunity"),
)
LOWEST_BAND = "Limited opportunity"

# Explanation bounds and wording

HIGH_VOLUME_FROM = 0.75
MODERATE_VOLUME_FROM = 0.35
HIGH_REPETITION_FROM = 0.8
LOW_REPETITION_BELOW = 0.4
LONG_HANDLING_FROM = 60
HIGH_ESCALATION_FROM = 0.30
LOW_ESCALATION_UP_TO = 0.08
LOW_CONSISTENCY_BELOW = 0.5
HIGH_CONSISTENCY_FROM = 0.8

HIGH_VOLUME = "High volume increases the potential impact"
MODERATE_VOLUME = "Moderate volume creates a meaningful opportunity"
LOW_VOLUME = "Lower volume limits the potential impact"
HIGH_REPETITION = "the workflow is highly repetitive"
LOW_REPETITION = "limited repetition reduces suitability"
LONG_HANDLING = (
    "long handling time increases potential savings but does not guarantee suitability"
)
HIGH_ESCALATION = "a high escalation rate reduces the score"
LOW_ESCALATION = "a low escalation rate supports automation suitability"
LOW_CONSISTENCY = "an inconsistent process reduces the score"
HIGH_CONSISTENCY = "a consistent process supports repeatable automation"

# Labels of the fact lines

FACT_COUNT = "Ticket count: "
FACT_PERCENTAGE = "Category percentage: "
FACT_MINUTES = "Average resolution minutes: "
FACT_HOURS = "Total handling hours: "
FACT_ESCALATION = "Escalation rate: "
FACT_SCORE = "Automation score: "

# Chart bounds

SCORE_AXIS_MAX = 108.0
AXIS_HEADROOM = 1.22

# Phrase lists of the question, answer and chat checks

KNOWN_METRIC_REQUESTS = (
    "ticket count",
    "how many tickets",
    "category percentage",
    "average resolution",
    "resolution minutes",
    "handling hours",
    "escalation rate",
    "automation score",
)
VAGUE_QUESTIONS = (
    "provide more information",
    "what are your business goals",
)
DOCUMENTED_REQUESTS = (
    "which systems are used",
    "what systems are used",
    "what are the manual steps",
    "what exception cases",
    "which exceptions are documented",
)
CANONICAL_METRIC_TERMS = (
    "ticket count",
    "category percentage",
    "average resolution",
    "resolution minutes",
    "handling hours",
    "escalation rate",
    "automation score",
)
ASSUMPTION_LABELS = (
    "General technical knowledge:",
    "Model assumption:",
    "Stakeholder clarification:",
)
FORBIDDEN_CLAIM = "guarantee"
STAKEHOLDER_LABEL = "stakeholder-provided clarification"

CONFIDENCE_LEVELS = ("low", "medium", "high")
CHAT_ROLES = ("user", "assistant")
QUESTION_ID_PATTERN = "^[a-z0-9_-]+$"
BATCH_LIMIT = 3
LEAST_LINES = 2
DEFAULT_HISTORY = 6
LARGEST_HISTORY = 20

# Issue wordings

ISSUE_UNKNOWN_CATEGORY = "Rejected unsupported category: "
ISSUE_DUPLICATE_CATEGORY = "Rejected duplicate category recommendation: "
ISSUE_REJECTED = "Rejected "
ISSUE_EVIDENCE = ": numeric evidence was missing or not an exact verified fact."
ISSUE_NUMERIC = ": numeric claims must appear only as exact evidence lines."
ISSUE_GUARANTEE = ": guaranteed outcomes are unsupported."

ISSUE_DUPLICATE_QUESTION = "Rejected duplicate clarification id: "
ISSUE_KNOWN_METRIC = "Rejected clarification that requests a canonical metric: "
ISSUE_VAGUE = "Rejected vague clarification: "
ISSUE_DOCUMENTED = "Rejected clarification that requests documented information: "
ISSUE_QUESTION_CATEGORY = "Rejected clarification with unsupported category: "

ISSUE_CONTRADICTION = "Stakeholder clarification cannot overwrite canonical audit metrics."

ISSUE_BLANK_QUESTION = "Chat question must not be empty"
ISSUE_OUTSIDE = "The chat response referenced evidence outside the verified audit context."
ISSUE_NEITHER = (
    "The chat response supplied neither verified evidence nor an explicit information gap."
)
ISSUE_UNLABELLED = "The chat response included an assumption without a source label."
ISSUE_NUMBER = "The chat response included a numeric claim without canonical evidence."
ISSUE_CHAT_GUARANTEE = "The chat response claimed an unsupported guarantee."

# Prefixes of the evidence catalog

CATALOG_RANKING = "Deterministic ranking — "
CATALOG_PROCESS = "Process documentation — "
CATALOG_RECOMMENDATION = "Verified recommendation — "
BULLET_START = "- **"

# Kinds of catalog lines

CATALOG_STEP = "repetitive step"
CATALOG_SYSTEM = "system"
CATALOG_EXCEPTION = "exception"
CATALOG_TITLE = "title"
CATALOG_RISK = "risk"
CATALOG_REVIEW = "human review"
