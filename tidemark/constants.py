"""Formats, labels, recipe names and parameters that results depend on."""

# labels of an interaction, in order of precedence
NEGATIVE, POSITIVE, PASSIVE = "explicit_negative_v1", "positive_v1", "passive_nonpositive_v1"
POSITIVE_VALUE = 3
MIN_POSITIVES = 5
MAX_HISTORY = 50
N_NEGATIVES = 100
EVAL_SEED = 20260804
TOP_K = 100

# identity records
CUTOFF_SCHEMA = "p3-full-exposure-cutoff-v1"
TARGET_SCHEMA = "p3-evaluation-target-v1"
TRAIN_SCHEMA = "p3-training-sample-v1"
CANDIDATE_RECIPE = "warm-target-plus-100-train-negatives-v1"
EPOCH_RECIPE = "sha256-training-seed-epoch-sample-id-order-v1"
NEGATIVE_RECIPE = "uniform-train-vocabulary-user-train-exclusion-v1"

# preference memory
MEMORY_RECIPE = "dynamic-hybrid-memory-v1"
PROTOTYPE_SCHEMA, TEXT_RECIPE = "p3-item-semantic-prototype-identity-v1", "tsv-item-semantic-text-v1"
MATCH_THRESHOLD = 0.70
EMA = 0.2
PROMOTION_TIMES = 2
MAX_LONG = 20
RECENT = 5
HALF_LIFE_DAYS = 7.0
INACTIVE = 0.10
SATURATION = 5.0
DAY_MS = 86_400_000

# stop reasons of the decision loop
BUDGET, NO_SEGMENTS, CERTAIN, TOO_LOW, SAFETY = (
    "budget_exhausted", "no_unobserved_segments", "ranking_sufficiently_certain", "max_segment_value_too_low", "safety_limit_reached",
)
MARGIN_THRESHOLD, MIN_VALUE, MAX_ACTIONS = 0.10, 0.15, 2

# raw interaction and category columns
RAW_COLUMNS = (
    "user_id", "pid", "author_id", "category_id", "category_level", "parent_id", "root_id", "exposed_time", "author_fans_count", "watch_time",
    "duration", "cvm_like", "click", "comment", "follow", "collect", "forward", "hate", "tag_name", "title", "p_hour", "p_date", "gender", "age",
    "mod_price", "fre_city", "fre_community_type", "fre_city_level",
)
CATEGORY_COLUMNS = ("category_level", "category_id", "category_name_cn", "parent_id", "root_id", "category_name_en")
FEEDBACK = ("cvm_like", "click", "comment", "follow", "collect", "forward", "hate")
