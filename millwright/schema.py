"""Data model: the readings table and the fixed values its rules use."""

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. Results depend on these exact names, words and bounds.
# ---------------------------------------------------------------------------

TABLE_NAME = "predictive_maintenance"

READINGS_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.LongType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("date", T.DateType()),
        T.StructField("shift", T.StringType()),
        T.StructField("equipment_id", T.StringType()),
        T.StructField("equipment_type", T.StringType()),
        T.StructField("plant_area", T.StringType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("temperature_c", T.DoubleType()),
        T.StructField("vibration_mm_s", T.DoubleType()),
        T.StructField("pressure_bar", T.DoubleType()),
        T.StructField("rpm", T.DoubleType()),
        T.StructField("load_percent", T.DoubleType()),
        T.StructField("efficiency_percent", T.DoubleType()),
        T.StructField("energy_consumption_kwh", T.DoubleType()),
        T.StructField("operating_hours", T.DoubleType()),
        T.StructField("maintenance_type", T.StringType()),
        T.StructField("days_since_last_maintenance", T.DoubleType()),
        T.StructField("failure_flag", T.IntegerType()),
        T.StructField("failure_type", T.StringType()),
        T.StructField("downtime_minutes", T.DoubleType()),
        T.StructField("failure_risk_level", T.StringType()),
    ]
)

# Place of a row in its files, if the reader was asked to keep it.
FILE_ORDER = "file_order"

# Text that a CSV cell may hold instead of a value (pandas' documented default list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Valid range of each measurement, (lower, upper); None = unbounded.
VALID_RANGE = {
    "temperature_c": (-50.0, 200.0),
    "vibration_mm_s": (0.0, 100.0),
    "pressure_bar": (0.0, 500.0),
    "rpm": (0.0, 10000.0),
    "load_percent": (0.0, 100.0),
    "efficiency_percent": (0.0, 100.0),
    "energy_consumption_kwh": (0.0, None),
    "operating_hours": (0.0, 100000.0),
    "days_since_last_maintenance": (0.0, 3650.0),
    "downtime_minutes": (0.0, 10080.0),
}

# Missing values: filled by the median of the equipment type, or of the whole column.
FILL_BY_TYPE = ["temperature_c", "vibration_mm_s", "pressure_bar", "rpm"]
FILL_BY_COLUMN = [
    "load_percent", "efficiency_percent", "energy_consumption_kwh", "days_since_last_maintenance",
]

# Missing values: filled by 0.
FILL_ZERO = ["operating_hours", "downtime_minutes"]

# Missing values: filled by a word.
FILL_WORD = {
    "shift": "Unknown",
    "equipment_id": "UNKNOWN",
    "equipment_type": "Unknown",
    "plant_area": "Unknown",
    "manufacturer": "Unknown",
    "maintenance_type": "None",
}

FAILED_WORDS = ["1", "1.0", "Yes", "yes", "Y", "y", "True"]
NO_FAILURE = "No Failure"
MIN_FAILURE_DOWNTIME = 30.0

RISK_WORDS = {
    "Low": ["low", "Low", "LOW"],
    "Medium": ["medium", "Medium", "MEDIUM", "Med"],
    "High": ["high", "High", "HIGH"],
    "Critical": ["critical", "Critical", "CRITICAL"],
}
RISK_WEIGHT = {"Low": 0.1, "Medium": 0.4, "High": 0.7, "Critical": 0.95}

# Bands are open below and closed above: (lower, upper, label).
URGENCY_BANDS = [(0, 25, "Low"), (25, 50, "Medium"), (50, 75, "High"), (75, 100, "Critical")]
CONDITION_BANDS = [(0, 40, "Critical"), (40, 60, "Poor"), (60, 80, "Fair"), (80, 100, "Good")]

PLANNED_MAINTENANCE = ["Preventive", "Predictive"]
UNPLANNED_MAINTENANCE = ["Corrective"]
