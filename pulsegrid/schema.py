"""Class codes, fixed value tables and table schemas."""

from pyspark.sql import types as T

# The five event classes, in code order.
CLASS_NAMES = ["N", "S", "V", "F", "Q"]
N_CLASSES = 5
N, S, V, F_, Q = range(5)

# Annotation symbol -> class code.
SYMBOL_CLASS = {
    "N": 0, "L": 0, "R": 0, "e": 0, "j": 0,
    "A": 1, "a": 1, "J": 1, "S": 1,
    "V": 2, "E": 2,
    "F": 3,
    "/": 4, "f": 4, "Q": 4,
}

# The published inter-patient record lists.
TRAIN_RECORDS = [
    101, 106, 108, 109, 112, 114, 115, 116, 118, 119, 122, 124,
    201, 203, 205, 207, 208, 209, 215, 220, 223, 230,
]
TEST_RECORDS = [
    100, 103, 105, 111, 113, 117, 121, 123, 200, 202, 210, 212,
    213, 214, 219, 221, 222, 228, 231, 232, 233, 234,
]

# Sampling rate and window around an event, in samples.
BASE_RATE = 360
PRE_SAMPLES = 90
POST_SAMPLES = 144
WINDOW = PRE_SAMPLES + POST_SAMPLES

SEEDS = [303, 1303, 2303, 3303, 4303]
VAL_FRACTION = 0.15
TRAIN_FRACTION = 0.67

# The dataset whose train/test transfer always uses the fixed decoder.
SHIFT_DATASET = "MIT-BIH"
SHIFT_DECODER = "clinical_default"

METRICS = (
    ["accuracy", "macro_f1_5", "macro_f1_4", "macro_f1_3_nsv"]
    + [f"{m}_{c}" for m in ("Se", "Pr", "F1") for c in CLASS_NAMES]
)

SIGNALS = T.StructType([
    T.StructField("record", T.StringType()),
    T.StructField("lead", T.IntegerType()),
    T.StructField("lead_name", T.StringType()),
    T.StructField("fs", T.DoubleType()),
    T.StructField("chunk", T.LongType()),
    T.StructField("start_idx", T.LongType()),
    T.StructField("values", T.ArrayType(T.FloatType())),
])

ANNOTATIONS = T.StructType([
    T.StructField("record", T.StringType()),
    T.StructField("ann_idx", T.LongType()),
    T.StructField("sample", T.LongType()),
    T.StructField("symbol", T.StringType()),
])

PROBS = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("seed", T.IntegerType()),
    T.StructField("role", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("beat_id", T.LongType()),
    T.StructField("y", T.IntegerType()),
    T.StructField("p", T.ArrayType(T.DoubleType())),
])

COUNTS_MAP = T.MapType(T.StringType(), T.IntegerType())

CANDIDATES = T.ArrayType(T.StructType([
    T.StructField("alpha", T.DoubleType()),
    T.StructField("decoder", T.StringType()),
    T.StructField("power", T.DoubleType()),
    T.StructField("multiplier", T.ArrayType(T.DoubleType())),
    T.StructField("val_macro_f1_4", T.DoubleType()),
    T.StructField("val_accuracy", T.DoubleType()),
    T.StructField("val_F1_S", T.DoubleType()),
    T.StructField("val_F1_F", T.DoubleType()),
]))

RUN_KEYS = ["dataset", "family", "method", "seed"]

RUN_DETAIL = T.StructType(
    [
        T.StructField("dataset", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("framework_method", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("train_size", T.LongType()),
        T.StructField("val_size", T.LongType()),
        T.StructField("test_size", T.LongType()),
        T.StructField("train_counts", T.StringType()),
        T.StructField("val_counts", T.StringType()),
        T.StructField("test_counts", T.StringType()),
        T.StructField("selected_alpha", T.DoubleType()),
        T.StructField("selected_decoder", T.StringType()),
        T.StructField("selected_power", T.DoubleType()),
        T.StructField("selected_multiplier", T.StringType()),
        T.StructField("validation_table", T.StringType()),
        T.StructField("train_time", T.DoubleType()),
        T.StructField("predict_time", T.DoubleType()),
    ]
    + [T.StructField(p + m, T.DoubleType()) for p in ("", "raw_", "delta_") for m in METRICS]
)
