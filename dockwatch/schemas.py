"""Table schemas and the fixed parameters of the domain."""

from pyspark.sql import types as T

# ---- fixed values: they must be these numbers for results to match --------
SLOT_MINUTES = 30
SLOTS_PER_DAY = 48
NEAR_LIMIT = 2            # near_empty / near_full: at most this many left
CRITICAL_MINUTES = 60     # an episode this long is critical
ALERT_WINDOW_HOURS = 6    # how far an episode is looked back
MODEL_EMPTY_MAX = 1       # model events: at most one bike left
MODEL_FULL_MAX = 1        # model events: at most one dock left
HORIZONS = (30, 60, 120, 180)
STRICT_THRESHOLD = 0.70
LAGS = (1, 2, 3, 4, 6, 12, 24, 48, 336)
WEEK_SLOTS = 336
STREAK_SLOTS = 6
NEIGHBOUR_KM = 1.0
NEIGHBOUR_COUNT = 5
KM_PER_DEGREE = 111.0
CLUSTERS = 6
SEED = 42
BRIDGE_DAYS = 28
HOLIDAY_REACH_DAYS = 21
NEW_STATION_BASE = 900000
RAW_KEEP_DAYS = 14
FILL_TARGET = 0.35        # dispatch fills a short station up to this share
DRAIN_TARGET = 0.65       # and drains a full one down to this share
MIN_MOVE = 3
COVER_SLOTS = 4
POLICY_CAPACITIES = (5, 10, 20, 40)
MIN_MODEL_SNAPSHOTS = 1000
# Model inputs: 42 columns in the order the models expect.
FEATURES = [
    "ratio", "bikes", "docks_total",
    "ratio_lag1", "ratio_lag2", "ratio_lag3", "ratio_lag4", "ratio_lag6", "ratio_lag12", "ratio_lag24",
    "ratio_lag48", "ratio_lag336", "d1", "d2", "d4",
    "roll_mean_4", "roll_std_4", "roll_mean_12", "roll_std_12", "roll_mean_48", "roll_min_48", "roll_max_48",
    "slot_of_day", "dow", "is_weekend", "is_holiday", "minutes_since_midnight",
    "capacity", "lat", "lon", "cluster_id", "district_id",
    "norm_ratio", "norm_dev", "norm_empty_rate", "norm_full_rate",
    "district_ratio", "cluster_ratio", "neigh_ratio", "neigh_dev", "empty_streak", "full_streak"]
# ---------------------------------------------------------------------------

LEVEL_RANK = {"notice": 1, "warning": 2, "critical": 3}

SNAPSHOT = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("bikes", T.ShortType()),
    T.StructField("docks_avail", T.ShortType()),
    T.StructField("docks_total", T.ShortType()),
])

STATION = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("capacity_docks", T.IntegerType()),
    T.StructField("first_ts", T.TimestampNTZType()),
    T.StructField("last_ts", T.TimestampNTZType()),
    T.StructField("n_snapshots", T.LongType()),
    T.StructField("always_empty", T.BooleanType()),
])

LATEST = T.StructType(SNAPSHOT.fields + [
    T.StructField("name", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])

HISTORY_CSV = T.StructType([
    T.StructField("raw_time", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("docks_total", T.IntegerType()),
    T.StructField("bikes", T.IntegerType()),
    T.StructField("docks_avail", T.IntegerType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
])

# Field names of the landed formats, as they arrive.
# One realtime record; every field is text.
REALTIME_JSON = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("sno", "sna", "sarea", "scity", "tot_quantity", "sbi_quantity", "bemp",
              "lng", "lat", "act", "yb2_quantity", "eyb_quantity", "mday")
])

HISTORICAL_JSON = T.StructType([
    T.StructField("StationUID", T.StringType()),
    T.StructField("SrcUpdateTime", T.StringType()),
    T.StructField("AvailableRentBikes", T.IntegerType()),
    T.StructField("AvailableReturnBikes", T.IntegerType()),
])

STATION_JSON = T.StructType([
    T.StructField("StationUID", T.StringType()),
    T.StructField("StationName", T.StructType([T.StructField("Zh_tw", T.StringType())])),
    T.StructField("StationAddress", T.StructType([T.StructField("Zh_tw", T.StringType())])),
    T.StructField("StationPosition", T.StructType([
        T.StructField("PositionLon", T.DoubleType()),
        T.StructField("PositionLat", T.DoubleType()),
    ])),
])

# A realtime record after typing (name is resolved to station_id later).
REALTIME_ROW = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("bikes", T.IntegerType()),
    T.StructField("docks_avail", T.IntegerType()),
    T.StructField("docks_total", T.IntegerType()),
    T.StructField("lon", T.DoubleType()),
    T.StructField("lat", T.DoubleType()),
    T.StructField("sno", T.StringType()),
    T.StructField("act", T.BooleanType()),
    T.StructField("bikes_yb2", T.IntegerType()),
    T.StructField("bikes_eyb", T.IntegerType()),
    T.StructField("mday", T.StringType()),
    T.StructField("fetched_at", T.TimestampNTZType()),
])

RAW_SNAPSHOT = T.StructType(
    SNAPSHOT.fields[:1] + [SNAPSHOT.fields[1]]
    + [f for f in REALTIME_ROW.fields if f.name in ("bikes", "docks_avail", "docks_total")]
    + [f for f in REALTIME_ROW.fields if f.name not in ("bikes", "docks_avail", "docks_total")]
)

FORECAST = T.StructType([
    T.StructField("station_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("base_ts", T.TimestampNTZType()),
    T.StructField("horizon", T.IntegerType()),
    T.StructField("now_bikes", T.IntegerType()),
    T.StructField("now_docks_avail", T.IntegerType()),
    T.StructField("docks_total", T.IntegerType()),
    T.StructField("pred_ratio", T.DoubleType()),
    T.StructField("pred_bikes", T.IntegerType()),
    T.StructField("pred_docks", T.IntegerType()),
    T.StructField("pred_bikes_lo", T.IntegerType()),
    T.StructField("pred_bikes_hi", T.IntegerType()),
    T.StructField("proba_empty", T.DoubleType()),
    T.StructField("proba_full", T.DoubleType()),
    T.StructField("alert_empty", T.BooleanType()),
    T.StructField("alert_full", T.BooleanType()),
    T.StructField("watch_empty", T.BooleanType()),
    T.StructField("watch_full", T.BooleanType()),
    T.StructField("thr_empty", T.DoubleType()),
    T.StructField("thr_full", T.DoubleType()),
    T.StructField("is_live", T.BooleanType()),
])

# Model inputs that are codes, and how many codes there are; the next one stands for all others.
MAX_DISTRICTS = 60
CATEGORICAL = {"cluster_id": CLUSTERS, "district_id": MAX_DISTRICTS, "dow": 7, "slot_of_day": SLOTS_PER_DAY}
