"""Values that define the results: column names, dates, rates, weights, presets.

Everything here is a fixed value; the logic that uses it lives elsewhere.
"""

# --- fixed values: input columns -------------------------------------------------
EVENT_COLUMNS = (
    "customer_id", "event_id", "event_dttm", "event_type_nm", "event_desc",
    "channel_indicator_type", "channel_indicator_sub_type", "operaton_amt",
    "currency_iso_cd", "mcc_code", "pos_cd", "timezone", "session_id",
    "operating_system_type", "battery", "device_system_version", "screen_size",
    "developer_tools", "phone_voip_call_state", "web_rdp_connection", "compromised",
)
ESSENTIAL_COLUMNS = (
    "event_id", "customer_id", "event_dttm", "operaton_amt", "mcc_code", "target",
    "session_id",
)
CATEGORY_COLUMNS = (
    "event_type_nm", "channel_indicator_type", "channel_indicator_sub_type",
    "currency_iso_cd", "mcc_code", "pos_cd", "accept_language", "browser_language",
    "timezone", "operating_system_type", "device_system_version",
    "phone_voip_call_state", "web_rdp_connection", "compromised", "battery",
    "screen_size", "developer_tools",
)
# the same column appears under two spellings in the wild
COLUMN_ALIASES = {"channel_indicator_subtype": "channel_indicator_sub_type"}

# --- fixed values: normalised integer columns, output name -> (input, Spark type) --
LENIENT_INTEGERS = {
    "session_id": ("session_id", "bigint"),
    "event_type_nm": ("event_type_nm", "int"),
    "event_desc": ("event_desc", "int"),
    "channel_indicator_type": ("channel_indicator_type", "smallint"),
    "channel_indicator_sub_type": ("channel_indicator_sub_type", "smallint"),
    "currency_iso_cd": ("currency_iso_cd", "smallint"),
    "pos_cd": ("pos_cd", "smallint"),
    "timezone": ("timezone", "int"),
    "operating_system_type": ("operating_system_type", "smallint"),
    "phone_voip_call_state": ("phone_voip_call_state", "tinyint"),
    "web_rdp_connection": ("web_rdp_connection", "tinyint"),
    "mcc_code_i": ("mcc_code", "int"),
    "developer_tools_i": ("developer_tools", "tinyint"),
    "compromised_i": ("compromised", "tinyint"),
}
# digits pulled out of text, output name -> (input, pattern with one group)
DIGIT_PATTERNS = {
    "battery_pct": ("battery", r"(\d{1,3})"),
    "os_ver_major": ("device_system_version", r"^(\d+)"),
    "screen_w": ("screen_size", r"^(\d+)"),
    "screen_h": ("screen_size", r"x(\d+)$"),
}
NULL_INTEGER = -1
NULL_CATEGORY = "MISSING"

# --- fixed values: feature table ------------------------------------------------
CATEGORICAL_FEATURES = (
    "customer_id", "event_type_nm", "event_desc", "channel_indicator_type",
    "channel_indicator_sub_type", "currency_iso_cd", "mcc_code_i", "pos_cd", "timezone",
    "operating_system_type", "phone_voip_call_state", "web_rdp_connection",
    "developer_tools_i", "compromised_i",
)
EVENT_FEATURES = (
    "amt", "amt_log_abs", "amt_is_negative", "hour", "weekday", "day", "month",
    "is_weekend", "event_day_number", "battery_pct", "os_ver_major", "screen_w",
    "screen_h", "screen_pixels", "screen_ratio", "session_id",
)
HISTORY_FEATURES = (
    "cust_prev_events", "cust_prev_amt_mean", "cust_prev_amt_std", "sec_since_prev_event",
    "amt_delta_prev", "cnt_prev_same_type", "cnt_prev_same_desc", "cnt_prev_same_mcc",
    "cnt_prev_same_subtype", "cnt_prev_same_session", "sec_since_prev_same_type",
    "sec_since_prev_same_desc", "events_before_today",
)
META_COLUMNS = (
    "event_id", "period", "event_ts", "is_train_sample", "is_test", "train_target_raw",
    "target_bin",
)
LEAKAGE_COLUMNS = ("target", "keep_green", "event_date")
NON_FEATURE_COLUMNS = (
    "event_id", "customer_id", "event_dttm", "target", "event_desc", "is_submit",
    "split_group",
)
ID_COLUMNS = ("event_id", "customer_id", "session_id")
PRIOR_KEYS = (
    "event_desc", "mcc_code_i", "timezone", "operating_system_type",
    "channel_indicator_sub_type", "event_type_nm", "pos_cd",
)
PLOTTED_FEATURES = {  # feature -> logarithmic axis
    "operaton_amt": True, "hour": False, "day_of_week": False,
    "seconds_since_prev": True, "amt_1h": True, "cnt_24h": False,
}

# --- fixed values: periods and borders ------------------------------------------
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
PERIODS = ("pretrain", "train", "pretest", "test")
TRAIN_START = "2024-10-01 00:00:00"
TEST_START = "2025-06-01 00:00:00"
SAMPLE_BORDER = "2025-04-01 00:00:00"
RECENT_BORDER = "2025-02-01 00:00:00"
FIXED_HOLDOUT_START = "2025-04-01 00:00:00"
FULL_HOLDOUT_START = "2025-05-01 00:00:00"
HISTORY_DAYS = 90
HOLDOUT_DAYS = 42
FALLBACK_TRAIN_SHARE = 0.8

# --- fixed values: features ------------------------------------------------------
FIRST_GAP_SECONDS = 999999
FIRST_GAP_FLAG = -1
WEEKEND_FROM_WEEKDAY = 5
NIGHT_BEFORE_HOUR = 6

# --- fixed values: sampling ------------------------------------------------------
RECENT_UNLABELLED_MODULUS = 10
OLD_UNLABELLED_MODULUS = 30
OLD_SEED_SHIFT = 17
ROTATION_STEP = 13
ROTATION_KEEP_PERCENT = 5
CUSTOMER_MODULUS = 20
PLOT_SAMPLE_ROWS = 50_000
HEAD_ROWS = 100_000
SEED = 42
SEEDS_FIVE = (42, 777, 2024, 1337, 555)
SEEDS_TEN = (42, 777, 2024, 1337, 555, 123, 456, 789, 101, 202)

# --- fixed values: priors, weights, blending ---------------------------------------
PRIOR_NUMERATOR = 1.0
PRIOR_COUNT_SMOOTHING = 200.0
PRIOR_LABELLED_SMOOTHING = 2.0
MAIN_WEIGHTS = {"red": 10.0, "yellow": 2.5, "green": 1.0}
SUSPICIOUS_WEIGHTS = {"labelled": 6.0, "unlabelled": 1.2}
RED_YELLOW_WEIGHTS = {"red": 2.2, "yellow": 1.0}
DYNAMIC_WEIGHT_FACTOR = 0.5
SIGMOID_CLIP = 40.0
LOGIT_CLIP = 1e-8
FIXED_BLEND = {"main": 0.7, "recent": 0.3}
# blend weights in steps of 1/20: main .30-.90, recent .00-.40
BLEND_STEPS = 20
BLEND_MAIN_STEPS = (6, 18)
BLEND_RECENT_STEPS = (0, 8)
HISTOGRAM_BINS = 50
TOP_DISPUTED = 10
REFIT_MIN_ITERATIONS = 300

# --- fixed values: boosted-tree presets (iterations, step, depth, wait, positive weight) --
BOOSTING_PRESETS = {
    "main": {"iterations": 2000, "step": 0.08, "depth": 6, "wait": 100, "pos_weight": 10.0},
    "ensemble": {"iterations": 5000, "step": 0.05, "depth": 6, "wait": 200, "pos_weight": None},
    "full": {"iterations": 5000, "step": 0.05, "depth": 8, "wait": 300, "pos_weight": None},
    "single": {"iterations": 3000, "step": 0.05, "depth": 6, "wait": 100, "pos_weight": 1.0},
    "stacked": {"iterations": 1500, "step": 0.08, "depth": 6, "wait": 50, "pos_weight": 5.0},
}
