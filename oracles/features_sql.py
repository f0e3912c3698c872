"""Checking SQL for cleaning, features and the reports on them, written apart from the Spark code."""

from .inputs import RAW_READINGS
from .readings_sql import FAILED, r

# Fixed values, written out here again so that a wrong one in the library shows.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
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
FAILED_WORDS = ["1", "1.0", "Yes", "yes", "Y", "y", "True"]
RISK_WORDS = {
    "Low": ["low", "Low", "LOW"],
    "Medium": ["medium", "Medium", "MEDIUM", "Med"],
    "High": ["high", "High", "HIGH"],
    "Critical": ["critical", "Critical", "CRITICAL"],
}

SENSOR_FILLS = ["temperature_c", "vibration_mm_s", "pressure_bar", "rpm"]
COLUMN_FILLS = [
    "load_percent", "efficiency_percent", "energy_consumption_kwh", "days_since_last_maintenance",
]


def _words(words: list[str]) -> str:
    return "(" + ", ".join(f"'{word}'" for word in words) + ")"


def _bounded(name: str) -> str:
    low, high = VALID_RANGE[name]
    value = f"TRY_CAST({name} AS DOUBLE)"
    top = "" if high is None else f"WHEN {value} > {high} THEN CAST({high} AS DOUBLE) "
    return f"CASE WHEN {value} < {low} THEN CAST({low} AS DOUBLE) {top}ELSE {value} END"


_LEVEL = " ".join(
    f"WHEN failure_risk_level IN {_words(words)} THEN '{level}'" for level, words in RISK_WORDS.items()
)

UNIQUE = f"""{RAW_READINGS}, unique_readings AS (
  SELECT * FROM raw_readings
  QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY timestamp, date, temperature_c) = 1
)"""

CLEAN = f"""{UNIQUE}, parsed AS (
  SELECT record_id,
    coalesce(TRY_CAST(timestamp AS TIMESTAMP), TRY_CAST(date AS TIMESTAMP)) AS timestamp,
    CAST(TRY_CAST(date AS TIMESTAMP) AS DATE) AS date,
    coalesce(shift, 'Unknown') AS shift, coalesce(equipment_id, 'UNKNOWN') AS equipment_id,
    coalesce(equipment_type, 'Unknown') AS equipment_type,
    coalesce(plant_area, 'Unknown') AS plant_area, coalesce(manufacturer, 'Unknown') AS manufacturer,
    {", ".join(f"{_bounded(name)} AS {name}" for name in SENSOR_FILLS + COLUMN_FILLS)},
    coalesce({_bounded("operating_hours")}, 0) AS operating_hours,
    coalesce(maintenance_type, 'None') AS maintenance_type,
    CASE WHEN failure_flag IN {_words(FAILED_WORDS)} THEN 1 ELSE 0 END AS flag,
    failure_type AS kind,
    coalesce({_bounded("downtime_minutes")}, 0) AS minutes,
    CASE {_LEVEL} ELSE 'Low' END AS failure_risk_level
  FROM unique_readings
), by_type AS (
  SELECT equipment_type, {", ".join(f"median({name}) AS m_{name}" for name in SENSOR_FILLS)}
  FROM parsed GROUP BY ALL
), part_filled AS (
  SELECT parsed.* REPLACE ({", ".join(f"coalesce({name}, m_{name}) AS {name}" for name in SENSOR_FILLS)})
  FROM parsed JOIN by_type USING (equipment_type)
), overall AS (
  SELECT {", ".join(f"median({name}) AS m_{name}" for name in SENSOR_FILLS + COLUMN_FILLS)}
  FROM part_filled
), clean AS (
  SELECT part_filled.* EXCLUDE (flag, kind, minutes)
      REPLACE ({", ".join(f"coalesce({name}, m_{name}) AS {name}" for name in SENSOR_FILLS + COLUMN_FILLS)}),
    flag AS failure_flag,
    CASE WHEN flag = 1 AND kind IS NOT NULL THEN kind ELSE 'No Failure' END AS failure_type,
    CASE WHEN flag = 1 AND minutes = 0 THEN 30 ELSE minutes END AS downtime_minutes,
    CAST(hour(timestamp) AS INTEGER) AS hour, CAST(isodow(timestamp) - 1 AS INTEGER) AS day_of_week,
    CAST(month(timestamp) AS INTEGER) AS month, CAST(year(timestamp) AS INTEGER) AS year,
    CAST(weekofyear(timestamp) AS INTEGER) AS week
  FROM part_filled, overall
)"""

FEATURED = f"""{CLEAN}, scored AS (
  SELECT *,
    coalesce((temperature_c - avg(temperature_c) OVER kind)
      / nullif(stddev_samp(temperature_c) OVER kind, 0), 0) AS temp_zscore,
    coalesce((vibration_mm_s - avg(vibration_mm_s) OVER kind)
      / nullif(stddev_samp(vibration_mm_s) OVER kind, 0), 0) AS vibration_zscore,
    (temperature_c - min(temperature_c) OVER ())
      / nullif(max(temperature_c) OVER () - min(temperature_c) OVER (), 0) AS temp_normalized,
    (vibration_mm_s - min(vibration_mm_s) OVER ())
      / nullif(max(vibration_mm_s) OVER () - min(vibration_mm_s) OVER (), 0) AS vibration_normalized,
    1 - efficiency_percent / 100 AS efficiency_normalized,
    load_percent / 100 AS load_normalized,
    days_since_last_maintenance / nullif(max(days_since_last_maintenance) OVER (), 0) AS waited,
    CAST(CASE failure_risk_level WHEN 'Low' THEN 0.1 WHEN 'Medium' THEN 0.4 WHEN 'High' THEN 0.7
           WHEN 'Critical' THEN 0.95 END AS DOUBLE) AS risk_numeric,
    downtime_minutes / 60 AS downtime_hours
  FROM clean WINDOW kind AS (PARTITION BY equipment_type)
), healthy AS (
  SELECT *, greatest(0, least(100, 100 * (1 - (temp_normalized * 25 + vibration_normalized * 30
      + efficiency_normalized * 25 + load_normalized * 20) / 100))) AS health_index
  FROM scored
), likely AS (
  SELECT *, greatest(0, least(100, (100 - health_index) * 0.5e0 + risk_numeric * 30 + waited * 20))
      AS failure_probability
  FROM healthy
), featured AS (
  SELECT * EXCLUDE (waited),
    CAST(abs(temp_zscore) > 2 AS INTEGER) AS temp_anomaly,
    CAST(abs(vibration_zscore) > 2 AS INTEGER) AS vibration_anomaly,
    CASE WHEN failure_probability <= 0 THEN NULL WHEN failure_probability <= 25 THEN 'Low'
      WHEN failure_probability <= 50 THEN 'Medium' WHEN failure_probability <= 75 THEN 'High'
      WHEN failure_probability <= 100 THEN 'Critical' END AS maintenance_urgency,
    CASE WHEN health_index <= 0 THEN NULL WHEN health_index <= 40 THEN 'Critical'
      WHEN health_index <= 60 THEN 'Poor' WHEN health_index <= 80 THEN 'Fair'
      WHEN health_index <= 100 THEN 'Good' END AS operating_condition,
    CASE WHEN failure_risk_level IN ('High', 'Critical') OR failure_probability > 70
      OR health_index < 40 THEN 1 ELSE 0 END AS high_risk_flag
  FROM likely
)"""

# --- columns by cleaning and feature step; floats are rounded ---------------------------------

TIMES = ["timestamp", "date", "hour", "day_of_week", "month", "year", "week"]
LABELS = ["shift", "equipment_id", "equipment_type", "plant_area", "manufacturer", "maintenance_type"]
FAILURE_FIELDS = ["failure_flag", "failure_type", "downtime_minutes"]
ANOMALIES = ["temp_zscore", "temp_anomaly", "vibration_zscore", "vibration_anomaly"]
NORMALIZED = ["temp_normalized", "vibration_normalized", "efficiency_normalized", "load_normalized"]
PROBABILITY = ["risk_numeric", "failure_probability", "maintenance_urgency", "high_risk_flag"]

CLEAN_STEPS = {
    "clean_times": TIMES,
    "clean_labels": LABELS,
    "clean_sensors": SENSOR_FILLS,
    "clean_load_efficiency_energy": COLUMN_FILLS[:3],
    "clean_hours_and_days": ["operating_hours", "days_since_last_maintenance"],
    "clean_failure_fields": FAILURE_FIELDS,
    "clean_risk_level": ["failure_risk_level"],
}
CLEAN_STEPS["clean_readings"] = [name for step in CLEAN_STEPS.values() for name in step]

FEATURE_STEPS = {
    "feature_anomalies": ANOMALIES,
    "feature_normalized": NORMALIZED,
    "feature_health_index": ["health_index", "operating_condition"],
    "feature_failure_probability": PROBABILITY,
    "feature_downtime_hours": ["downtime_hours"],
}
FEATURE_STEPS["featured_readings"] = CLEAN_STEPS["clean_readings"] + [
    name for step in FEATURE_STEPS.values() for name in step
]

_FLOATS = {
    *SENSOR_FILLS, *COLUMN_FILLS, *NORMALIZED, "operating_hours", "downtime_minutes", "temp_zscore",
    "vibration_zscore", "health_index", "risk_numeric", "failure_probability", "downtime_hours",
}


def _columns(names: list[str]) -> str:
    return ", ".join(r(name, name) if name in _FLOATS else name for name in ["record_id", *names])


_RAW_NAMES = [
    "record_id", "timestamp", "date", "shift", "equipment_id", "equipment_type", "plant_area",
    "manufacturer", *SENSOR_FILLS, *COLUMN_FILLS[:3], "operating_hours", "maintenance_type",
    "days_since_last_maintenance", "failure_flag", "failure_type", "downtime_minutes",
    "failure_risk_level",
]
_NULLS = "count(*) FILTER (WHERE {0} IS NULL) AS {0}"
_PROFILED = [*SENSOR_FILLS, *COLUMN_FILLS[:3]]

RAW_QUERIES = {
    "clean_unique_records": f"WITH {UNIQUE} SELECT * FROM unique_readings",
    "dq_null_profile": f"""WITH {UNIQUE}
      SELECT {", ".join(_NULLS.format(name) for name in _PROFILED)} FROM unique_readings""",
    "dq_dedup_report": f"""WITH {RAW_READINGS}
      SELECT count(*) AS initial_rows,
        count(*) - count(DISTINCT record_id) - max(CASE WHEN record_id IS NULL THEN 1 ELSE 0 END)
          AS duplicates_removed
      FROM raw_readings""",
    "source_csv": f"""WITH {RAW_READINGS}
      SELECT {", ".join(f"CASE WHEN {name} NOT IN {_words(NA_TOKENS)} THEN {name} END AS {name}" for name in _RAW_NAMES)}
      FROM raw_readings""",
}

CLEAN_QUERIES = {
    **{name: f"WITH {CLEAN} SELECT {_columns(columns)} FROM clean" for name, columns in CLEAN_STEPS.items()},
    "clean_gap_values": f"""WITH {CLEAN}
      SELECT equipment_type,
        {", ".join(f"coalesce(by_type.m_{name}, overall.m_{name}) AS fill_{name}" for name in SENSOR_FILLS)},
        {", ".join(f"overall.m_{name} AS fill_{name}" for name in COLUMN_FILLS)}
      FROM by_type, overall""",
    "dq_null_profile_clean": f"""WITH {CLEAN}
      SELECT {", ".join(_NULLS.format(name) for name in ["record_id", *CLEAN_STEPS["clean_readings"]])}
      FROM clean""",
    "dq_clean_shape": f"""WITH {CLEAN}
      SELECT count(*) AS row_count, {len(CLEAN_STEPS["clean_readings"]) + 1} AS column_count FROM clean""",
}

FEATURE_QUERIES = {
    name: f"WITH {FEATURED} SELECT {_columns(columns)} FROM featured"
    for name, columns in FEATURE_STEPS.items()
}

# --- reports ----------------------------------------------------------------------------------

# Gaps between a machine's consecutive failures, one by one; Spark uses the span of its failures.
_GAPS = """gaps AS (
  SELECT equipment_type, (epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (
      PARTITION BY equipment_type, equipment_id ORDER BY timestamp))) / 3.6e9 AS gap
  FROM featured WHERE failure_flag = 1 AND timestamp IS NOT NULL
)"""
_ALL_GAPS = _GAPS.replace("PARTITION BY equipment_type, equipment_id", "PARTITION BY equipment_id")


def _sum_int(column: str, name: str) -> str:
    return f"CAST(sum({column}) AS BIGINT) AS {name}"


def _mean(column: str, name: str) -> str:
    return r(f"avg({column})", name)


_SCORES = f"""{_mean("health_index", "avg_health_index")},
        {_mean("failure_probability", "avg_failure_probability")}"""
_CONDITIONS = f"""{_mean("temperature_c", "avg_temperature")}, {_mean("vibration_mm_s", "avg_vibration")}"""

_DOWNTIME = f"""
      SELECT equipment_id, equipment_type, {r("minutes", "total_downtime_minutes")},
        {r("down", "total_downtime_hours")}, failure_count, {r("hours", "total_operating_hours")},
        avg_health_index, avg_failure_probability, high_risk_count, measurement_count,
        {r("CASE WHEN hours > 0 THEN greatest(0, least(100, (1 - down / hours) * 100)) WHEN down > 0 THEN 0 END", "availability_pct")},
        {r("CASE WHEN failure_count > 0 THEN down / failure_count WHEN down = 0 THEN 0 END", "avg_downtime_per_failure")}
      FROM (SELECT equipment_id, equipment_type, sum(downtime_minutes) AS minutes,
              sum(downtime_hours) AS down, {_sum_int("failure_flag", "failure_count")},
              max(operating_hours) AS hours, {_SCORES}, {_sum_int("high_risk_flag", "high_risk_count")},
              count(record_id) AS measurement_count
            FROM featured GROUP BY equipment_id, equipment_type)"""

_HEALTH = f"""
      , machines AS (
        SELECT equipment_id, equipment_type, plant_area, avg(health_index) AS health,
          {_mean("failure_probability", "avg_failure_probability")}, {_CONDITIONS},
          {r("max(temperature_c)", "max_temperature")}, {r("max(vibration_mm_s)", "max_vibration")},
          {_mean("pressure_bar", "avg_pressure")}, {_mean("efficiency_percent", "avg_efficiency")},
          {r("max(operating_hours)", "total_operating_hours")},
          {_mean("days_since_last_maintenance", "avg_days_since_maintenance")},
          {_sum_int("failure_flag", "failure_count")}, {_sum_int("high_risk_flag", "high_risk_count")},
          count(record_id) AS measurement_count
        FROM featured GROUP BY equipment_id, equipment_type, plant_area),
      placed AS (
        SELECT *, rank() OVER (ORDER BY round(health, 9))
            + (count(*) OVER (PARTITION BY round(health, 9)) - 1) / 2 AS place FROM machines)
      SELECT * EXCLUDE (health, place), {r("health", "avg_health_index")},
        CAST(place AS DOUBLE) AS maintenance_priority,
        CASE WHEN health <= 0 THEN NULL WHEN health <= 40 THEN 'Critical' WHEN health <= 60 THEN 'Poor'
             WHEN health <= 80 THEN 'Fair' ELSE 'Good' END AS health_status
      FROM placed"""

_MONTHLY = f"""
      SELECT year, month, {_sum_int("failure_flag", "failure_count")}, count(record_id) AS total_records,
        {_SCORES}, {_CONDITIONS}, {_mean("efficiency_percent", "avg_efficiency")},
        {r("sum(downtime_hours)", "total_downtime_hours")},
        {_sum_int("high_risk_flag", "high_risk_count")},
        {r("sum(energy_consumption_kwh)", "total_energy_consumption")},
        {r("sum(failure_flag) * 100 / count(record_id)", "failure_rate_pct")}
      FROM featured WHERE year IS NOT NULL GROUP BY year, month"""

_ALERTS = f"""
      , levels AS (
        SELECT equipment_id, equipment_type, plant_area, failure_risk_level, count(*) AS n
        FROM featured WHERE high_risk_flag = 1 GROUP BY ALL),
      usual AS (
        SELECT equipment_id, equipment_type, plant_area, failure_risk_level AS risk_level FROM levels
        QUALIFY row_number() OVER (PARTITION BY equipment_id, equipment_type, plant_area
          ORDER BY n DESC, failure_risk_level) = 1),
      worst AS (
        SELECT equipment_id, equipment_type, plant_area, min(health_index) AS health,
          max(failure_probability) AS chance, {r("max(temperature_c)", "max_temperature")},
          {r("max(vibration_mm_s)", "max_vibration")},
          {r("max(days_since_last_maintenance)", "days_since_maintenance")},
          max(timestamp) AS last_reading
        FROM featured WHERE high_risk_flag = 1 GROUP BY ALL)
      SELECT equipment_id, equipment_type, plant_area, {r("health", "current_health_index")},
        {r("chance", "max_failure_probability")}, max_temperature, max_vibration,
        days_since_maintenance, risk_level, last_reading,
        CASE WHEN health < 30 OR chance > 90 THEN 'CRITICAL' WHEN health < 50 OR chance > 70 THEN 'HIGH'
             ELSE 'MEDIUM' END AS alert_severity
      FROM worst JOIN usual USING (equipment_id, equipment_type, plant_area)"""

REPORTS = {
    "overall_kpis": f""", {_ALL_GAPS}
      SELECT {r("avg(failure_flag) * 100", "failure_rate_pct")},
        {r("(SELECT coalesce(avg(gap), 0) FROM gaps)", "mtbf_hours")},
        {r(f"coalesce(avg(downtime_hours) {FAILED}, 0)", "mttr_hours")},
        {_sum_int("high_risk_flag", "high_risk_count")},
        count(DISTINCT equipment_id) FILTER (WHERE high_risk_flag = 1) AS high_risk_equipment_count,
        {_mean("temperature_c", "avg_temperature_c")}, {_mean("vibration_mm_s", "avg_vibration_mm_s")},
        {_mean("health_index", "avg_health_index")},
        {_mean("failure_probability", "avg_failure_probability_pct")},
        {r("sum(downtime_hours)", "total_downtime_hours")},
        {r("sum(downtime_minutes)", "total_downtime_minutes")},
        {r("coalesce(100 - sum(downtime_hours) * 100 / nullif(sum(operating_hours), 0), 100)", "availability_pct")},
        count(DISTINCT equipment_id) AS total_equipment,
        count(DISTINCT equipment_id) {FAILED} AS failed_equipment,
        {_mean("days_since_last_maintenance", "avg_days_since_maintenance")}
      FROM featured""",
    "risk_distribution_features": f"""
      SELECT failure_risk_level AS risk_level, count(record_id) AS record_count,
        count(DISTINCT equipment_id) AS equipment_count, {_sum_int("failure_flag", "failure_count")},
        {r("sum(downtime_hours)", "total_downtime_hours")}, {_SCORES},
        {r("count(record_id) * 100 / sum(count(record_id)) OVER ()", "percentage")}
      FROM featured GROUP BY failure_risk_level""",
    "downtime_per_equipment": _DOWNTIME,
    "equipment_health": _HEALTH,
    "failure_analysis": f"""
      SELECT failure_type, count(record_id) AS occurrence_count,
        count(DISTINCT equipment_id) AS affected_equipment,
        {r("sum(downtime_hours)", "total_downtime_hours")}, {_mean("downtime_hours", "avg_downtime_hours")},
        {r("max(downtime_hours)", "max_downtime_hours")}, {_CONDITIONS},
        {_mean("load_percent", "avg_load")}, {_mean("operating_hours", "avg_operating_hours")},
        {r("count(record_id) * 100 / sum(count(record_id)) OVER ()", "percentage")}
      FROM featured WHERE failure_flag = 1 GROUP BY failure_type""",
    "monthly_trends": _MONTHLY,
    "equipment_type_kpis": f""", {_GAPS}, mean_gaps AS (
        SELECT equipment_type, avg(gap) AS mean_gap FROM gaps GROUP BY ALL)
      SELECT equipment_type, count(DISTINCT equipment_id) AS equipment_count,
        {_sum_int("failure_flag", "failure_count")}, {_mean("failure_flag", "failure_rate")}, {_SCORES},
        {r("sum(downtime_hours)", "total_downtime_hours")}, {_CONDITIONS},
        {_mean("efficiency_percent", "avg_efficiency")},
        {r("sum(operating_hours)", "total_operating_hours")},
        {_sum_int("high_risk_flag", "high_risk_count")}, count(record_id) AS measurement_count,
        {r("avg(failure_flag) * 100", "failure_rate_pct")},
        {r("coalesce(any_value(mean_gap), 0)", "mtbf_hours")}
      FROM featured LEFT JOIN mean_gaps USING (equipment_type) GROUP BY equipment_type""",
    "predictive_alerts": _ALERTS,
    "most_downtime": f"""{_DOWNTIME}
      ORDER BY minutes DESC, equipment_id, equipment_type LIMIT 10""",
    "least_healthy": f"""{_HEALTH}
      ORDER BY place NULLS LAST, equipment_id, equipment_type, plant_area LIMIT 10""",
    "latest_months": f"{_MONTHLY} ORDER BY year DESC, month DESC LIMIT 12",
    "first_alerts": f"""{_ALERTS}
      ORDER BY CASE alert_severity WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 ELSE 3 END,
        health NULLS LAST, equipment_id, equipment_type, plant_area LIMIT 20""",
    "downtime_risk": f"""
      SELECT equipment_id, {r("chance", "avg_failure_probability")}, {r("down", "avg_downtime_per_failure")},
        {r("chance / 100 * coalesce(down, 0)", "downtime_risk_hours")}
      FROM (SELECT equipment_id, avg(failure_probability) AS chance, avg(downtime_hours) {FAILED} AS down
            FROM featured GROUP BY ALL)""",
    "filtered_view": f"""
      SELECT {_columns(["equipment_id", "timestamp", "maintenance_type", "operating_condition", "health_index", "failure_probability"])}
      FROM featured
      WHERE maintenance_type = 'Preventive' AND operating_condition = 'Fair'
        AND timestamp >= TIMESTAMP '2024-03-01' AND timestamp < TIMESTAMP '2024-09-01'""",
}

ON_EVENTS = {
    **RAW_QUERIES,
    **CLEAN_QUERIES,
    **FEATURE_QUERIES,
    **{name: f"WITH {FEATURED}\n{sql.strip()}" for name, sql in REPORTS.items()},
}
