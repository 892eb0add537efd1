"""Canonical dialogue-state catalogue and other fixed values.

Everything in the FIXED VALUES block must equal the values used by the original benchmark
for results to agree (rendering order of slots, inactive constraint values, phrases, prompt
markers). They are data, not logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the benchmark for identical results)
# ---------------------------------------------------------------------------

# Belief-state slots per domain, in rendering order.
BELIEF_SLOTS: dict[str, list[str]] = {
    "general": ["active_domain", "city"],
    "restaurant": ["name", "genre", "area", "pricerange", "station", "wifi", "parking"],
    "hotel": ["name", "genre", "area", "pricerange", "station", "wifi", "parking", "withrestaurant"],
    "attraction": ["name", "genre", "area", "station", "wifi", "parking"],
    "shopping": ["name", "genre", "area", "station", "parking"],
    "taxi": ["name", "cashless", "jumbo"],
    "weather": ["area", "day"],
}

# Booking slots per domain, in rendering order.
BOOK_SLOTS: dict[str, list[str]] = {
    "restaurant": ["people", "day", "time"],
    "hotel": ["people", "day", "stay"],
    "taxi": ["day", "time", "departurepoint", "arrivalpoint"],
}

# Domains that have a booking result (success, ref).
BOOK_RESULT_DOMAINS: list[str] = ["restaurant", "hotel", "taxi"]

# Entity database files, one per domain.
ENTITY_DOMAINS: list[str] = ["attraction", "hotel", "restaurant", "shopping", "taxi", "weather"]

# Constraint values that mean "no constraint".
NOT_QUERY_VALUES: list[str | None] = [None, "", "dontcare", "非対応", "無し", "不明"]

# Taxi booking slots ignored when comparing a booking with the goal.
TAXI_IGNORED_BOOK_SLOTS: list[str] = ["departurepoint", "arrivalpoint"]

# Domain whose candidate list is emptied when it has more than one entry.
MULTI_CANDIDATE_DROP_DOMAIN = "weather"

# Default prompt / text markers.
DST_TASK_PREFIX = "対話から信念状態を推定:"
RG_TASK_PREFIX = "対話から応答を生成:"
USER_PREFIX = "<顧客>"
SYSTEM_PREFIX = "<店員>"
STATE_PREFIX = "<信念状態>"
DB_RESULT_PREFIX = "<検索結果>"
BOOK_RESULT_PREFIX = "<予約結果>"
MAX_CANDIDATE_ENTITIES = 3

# Few-shot index defaults: context utterances, dialogues per domain, neighbours.
INDEX_CONTEXT_TURNS = 2
INDEX_DIALOGUES_PER_DOMAIN = 20
FEWSHOT_EXAMPLES = 2
LLM_CONTEXT_TURNS = 5

# Human-evaluation session values.
SUCCESS_PHRASE = "success"
FAILURE_PHRASE = "fail"
MAX_SESSION_TURNS = 40
SESSION_END_TEXT = "【対話を終了します。】"
SESSION_LIMIT_TEXT = "【発話数の上限に達しました。】"

# Bot-text punctuation normalisation (source -> target), applied in this order,
# first occurrence only.
PUNCT_REPLACEMENTS: list[tuple[str, str]] = [
    ("，", "、"), (",", "、"), ("．", "。"), (".", "。"), ("!", "！"), ("?", "？"),
]

# Booking reference range when no oracle reference is given: 1 .. 99999.
BOOK_REF_MODULUS = 99999

# Prompt section markers (format of the few-shot prompts).
PROMPT_EXAMPLE_HEADER = "\n=== 対話例 {i} ===\n"
PROMPT_INPUT = "### 入力\n"
PROMPT_OUTPUT = "### 出力\n"
PROMPT_EXAMPLES_END = "======\nでは，以下の事例を完了してください:\n"

# Transcript export: talker labels of the user and the system.
TRANSCRIPT_USER = "U"
TRANSCRIPT_SYSTEM = "S"

# ---------------------------------------------------------------------------


def catalogue_rows(belief: dict[str, list[str]] = BELIEF_SLOTS,
                   book: dict[str, list[str]] = BOOK_SLOTS) -> list[tuple]:
    """(domain, domain_pos, kind, slot, slot_pos) rows; slot_pos is the rendering order.

    Per domain, belief slots come first and then book slots; book-only domains are dropped
    (they are never rendered).
    """
    rows = []
    for d_pos, (domain, slots) in enumerate(belief.items()):
        pos = 0
        for s in slots:
            rows.append((domain, d_pos, "belief", s, pos))
            pos += 1
        for s in book.get(domain, []):
            rows.append((domain, d_pos, "book", s, pos))
            pos += 1
    return rows


CATALOGUE_SCHEMA = T.StructType([
    T.StructField("domain", T.StringType(), False),
    T.StructField("domain_pos", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("slot", T.StringType(), False),
    T.StructField("slot_pos", T.IntegerType(), False),
])


def slot_catalogue(spark: SparkSession, belief: dict[str, list[str]] = BELIEF_SLOTS,
                   book: dict[str, list[str]] = BOOK_SLOTS) -> DataFrame:
    """Slot catalogue as a (bounded, tiny) DataFrame; safe to broadcast."""
    return spark.createDataFrame(catalogue_rows(belief, book), CATALOGUE_SCHEMA)
