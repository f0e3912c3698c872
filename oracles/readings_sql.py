"""Checking SQL for the measures on typed readings, written apart from the Spark code.

Every query runs on the `readings` expression. Floats are rounded to 6 places, and whole numbers
are given the types Spark returns.
"""

FAILED = "FILTER (WHERE failure_flag = 1)"
RISKY = "FILTER (WHERE failure_risk_level = 'High')"
MONTH = "CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month"
REPAIRS = "(SELECT * FROM readings WHERE failure_flag = 1 AND downtime_minutes IS NOT NULL)"
HIGH = "(SELECT * FROM readings WHERE failure_risk_level = 'High')"
RATED = "(SELECT * FROM readings WHERE failure_risk_level IS NOT NULL)"
WARM = "(SELECT * FROM readings WHERE temperature_c IS NOT NULL)"
SHAKING = "(SELECT * FROM readings WHERE vibration_mm_s IS NOT NULL)"


def pct(part: str, whole: str) -> str:
    return dec(f"({part}) * 100e0 / nullif({whole}, 0)", digits=5)


def dec(value: str, digits: int = 18) -> str:
    """2 places; the nudge makes a half go away from 0 however its sum was ordered."""
    return f"CAST(round(({value}) + sign({value}) * 1e-9, 2) AS DECIMAL({digits},2))"


def rounded(value: str) -> str:
    """6 places; the nudge makes a tie go up however its sum was ordered."""
    return f"round({value} + 1e-9, 6)"


def r(value: str, name: str) -> str:
    return f"{rounded(value)} AS {name}"


FAILURE_RATE = (
    f"count(*) AS total_records, count(*) {FAILED} AS failures, "
    + pct(f"count(*) {FAILED}", "count(*)") + " AS failure_rate_pct"
)
HOURS_PER_FAILURE = (
    r("sum(operating_hours)", "total_operating_hours")
    + f", count(*) {FAILED} AS total_failures, "
    + dec(f"sum(operating_hours) / nullif(count(*) {FAILED}, 0)") + " AS mtbf_hours"
)
MINUTES = r("sum(downtime_minutes)", "total_downtime_minutes")
HOURS = dec("sum(downtime_minutes) / 60") + " AS total_downtime_hours"
MEAN = "avg(downtime_minutes)"
MEAN_HOURS = dec("avg(downtime_minutes) / 60")
PER_FAILURE = r(MEAN, "avg_downtime_per_failure")
LEAST, MOST = r("min(downtime_minutes)", "min_downtime"), r("max(downtime_minutes)", "max_downtime")
SEEN = "count(DISTINCT equipment_id)"


def spread(column: str, label: str) -> str:
    return ", ".join(
        r(f"{f}({column})", f"{name}_{label}")
        for f, name in [("avg", "avg"), ("min", "min"), ("max", "max"), ("stddev_samp", "std_dev")]
    )


QUALITY = {
    "dq_completeness": """
      SELECT count(*) AS total_records, count(record_id) AS records_with_id,
        count(equipment_id) AS records_with_equipment, count(timestamp) AS records_with_timestamp,
        count(temperature_c) AS records_with_temp, count(vibration_mm_s) AS records_with_vibration,
        count(pressure_bar) AS records_with_pressure, count(failure_flag) AS records_with_failure_flag
      FROM readings""",
    "dq_null_sensors": """
      SELECT record_id, equipment_id, timestamp, temperature_c, vibration_mm_s, pressure_bar
      FROM readings
      WHERE temperature_c + vibration_mm_s + pressure_bar + rpm IS NULL""",
    "dq_duplicate_readings": """
      SELECT equipment_id, timestamp, count(*) AS duplicate_count
      FROM readings GROUP BY ALL HAVING count(*) >= 2""",
    "dq_duplicate_record_ids": """
      SELECT record_id, count(*) AS count FROM readings GROUP BY ALL HAVING count(*) >= 2""",
    "dq_out_of_range_sensors": """
      SELECT record_id, equipment_id, temperature_c, vibration_mm_s, pressure_bar, rpm, load_percent
      FROM readings
      WHERE temperature_c NOT BETWEEN -50 AND 200 OR vibration_mm_s NOT BETWEEN 0 AND 100
        OR pressure_bar NOT BETWEEN 0 AND 500 OR load_percent NOT BETWEEN 0 AND 100 OR rpm < 0""",
    "dq_illogical_hours": """
      SELECT record_id, equipment_id, operating_hours, efficiency_percent
      FROM readings
      WHERE efficiency_percent NOT BETWEEN 0 AND 100 OR operating_hours < 0""",
    "dq_failure_consistency": """
      SELECT record_id, failure_flag, failure_type, downtime_minutes
      FROM readings
      WHERE CASE failure_flag WHEN 1 THEN failure_type IS NULL OR downtime_minutes IS NULL
                              WHEN 0 THEN downtime_minutes > 0 END""",
    "dq_temp_outliers": f"""
      SELECT record_id, equipment_id, temperature_c, {r("mean", "mean_temp")},
        {r("abs(temperature_c - mean) / std", "z_score")}
      FROM (SELECT *, avg(temperature_c) OVER () AS mean, stddev_samp(temperature_c) OVER () AS std
            FROM readings)
      WHERE abs(temperature_c - mean) > 3 * std""",
    "dq_vibration_outliers": f"""
      SELECT record_id, equipment_id, equipment_type, vibration_mm_s, {r("mean", "mean_vib")},
        {r("abs(vibration_mm_s - mean) / std", "z_score")}
      FROM (SELECT *, avg(vibration_mm_s) OVER kind AS mean, stddev_samp(vibration_mm_s) OVER kind AS std
            FROM readings WINDOW kind AS (PARTITION BY equipment_type))
      WHERE abs(vibration_mm_s - mean) > 3 * std""",
}

RELIABILITY = {
    "failure_rate_overall": f"SELECT {FAILURE_RATE.replace('AS failures', 'AS total_failures')} FROM readings",
    "failure_rate_by_type": f"SELECT equipment_type, {FAILURE_RATE} FROM readings GROUP BY ALL",
    "failure_rate_by_equipment": f"""
      SELECT equipment_id, equipment_type, plant_area, {FAILURE_RATE} FROM readings GROUP BY ALL""",
    "failure_rate_monthly": f"SELECT {MONTH}, {FAILURE_RATE} FROM readings GROUP BY 1, 2",
    "failure_rate_by_shift": f"SELECT shift, {FAILURE_RATE} FROM readings GROUP BY ALL",
    # Numbered failures joined to the one before, where the Spark job uses time slots.
    "mtbf_by_equipment": f"""
      , numbered AS (
        SELECT equipment_id, equipment_type, operating_hours, row_number() OVER (
          PARTITION BY equipment_id ORDER BY timestamp NULLS FIRST, record_id NULLS FIRST) AS nth
        FROM readings WHERE failure_flag = 1),
      gaps AS (
        SELECT later.equipment_id, later.equipment_type,
          later.operating_hours - coalesce(earlier.operating_hours, 0) AS hours
        FROM numbered AS later LEFT JOIN numbered AS earlier
          ON earlier.equipment_id = later.equipment_id AND earlier.nth + 1 = later.nth
        WHERE later.nth >= 2)
      SELECT equipment_id, equipment_type, count(*) AS failure_intervals,
        {r("avg(hours)", "mtbf_hours")}, {r("min(hours)", "min_time_between_failures")},
        {r("max(hours)", "max_time_between_failures")}, {r("stddev_samp(hours)", "std_dev_hours")}
      FROM gaps GROUP BY ALL""",
    "mtbf_by_type": f"SELECT equipment_type, {HOURS_PER_FAILURE} FROM readings GROUP BY ALL",
    "mtbf_by_area": f"SELECT plant_area, equipment_type, {HOURS_PER_FAILURE} FROM readings GROUP BY ALL",
}

REPAIR = {
    "mttr_by_type": f"""
      SELECT equipment_type, count(*) AS total_failures, {r(MEAN, "mttr_minutes")}, {LEAST}, {MOST},
        {r("stddev_samp(downtime_minutes)", "std_dev_minutes")}, {MEAN_HOURS} AS mttr_hours
      FROM {REPAIRS} GROUP BY ALL""",
    "mttr_by_equipment": f"""
      SELECT equipment_id, equipment_type, manufacturer, count(*) AS failure_count,
        {r(MEAN, "mttr_minutes")}, {MINUTES}, {MEAN_HOURS} AS mttr_hours
      FROM {REPAIRS} GROUP BY ALL""",
    "mttr_by_failure_type": f"""
      SELECT failure_type, count(*) AS failure_count, {r(MEAN, "mttr_minutes")},
        {r("min(downtime_minutes)", "min_repair_time")},
        {r("max(downtime_minutes)", "max_repair_time")}, {MEAN_HOURS} AS mttr_hours
      FROM {REPAIRS} GROUP BY ALL HAVING failure_type IS NOT NULL""",
    "mttr_monthly": f"""
      SELECT {MONTH}, count(*) AS failure_count, {r(MEAN, "mttr_minutes")}, {MEAN_HOURS} AS mttr_hours
      FROM {REPAIRS} GROUP BY 1, 2""",
}

HIGH_RISK = {
    "high_risk_count": f"""
      SELECT {SEEN} AS high_risk_equipment_count, count(*) AS high_risk_records FROM {HIGH}""",
    "high_risk_by_type_area": f"""
      SELECT equipment_type, plant_area, {SEEN} AS high_risk_equipment, count(*) AS high_risk_records
      FROM {HIGH} GROUP BY ALL""",
    "high_risk_equipment_detail": f"""
      SELECT equipment_id, equipment_type, plant_area, manufacturer, count(*) AS high_risk_occurrences,
        {r("avg(temperature_c)", "avg_temp")}, {r("avg(vibration_mm_s)", "avg_vibration")},
        max(timestamp) AS last_high_risk_timestamp
      FROM {HIGH} GROUP BY ALL""",
    "high_risk_monthly": f"""
      SELECT {MONTH}, {SEEN} AS high_risk_equipment, count(*) AS high_risk_records
      FROM {HIGH} GROUP BY 1, 2""",
}

SENSORS = {
    "temp_overall": f"SELECT {spread('temperature_c', 'temperature')} FROM readings",
    "temp_by_type": f"""
      SELECT equipment_type, {spread('temperature_c', 'temperature')}, count(*) AS record_count
      FROM {WARM} GROUP BY ALL""",
    "temp_by_equipment": f"""
      SELECT equipment_id, equipment_type, plant_area, {r("avg(temperature_c)", "avg_temperature")},
        {r("max(temperature_c)", "max_temperature")},
        {r(f"avg(temperature_c) {FAILED}", "avg_temp_at_failure")}
      FROM {WARM} GROUP BY ALL""",
    "temp_daily_trend": f"""
      SELECT equipment_id, CAST(timestamp AS DATE) AS date,
        {r("avg(temperature_c)", "avg_daily_temperature")},
        {r("max(temperature_c)", "max_daily_temperature")},
        {r("min(temperature_c)", "min_daily_temperature")}
      FROM {WARM} GROUP BY 1, 2""",
    "temp_normal_vs_failure": f"""
      SELECT equipment_type, {r("normal", "avg_temp_normal")}, {r("bad", "avg_temp_failure")},
        {r("bad - normal", "temp_diff")}
      FROM (SELECT equipment_type, avg(temperature_c) FILTER (WHERE failure_flag = 0) AS normal,
              avg(temperature_c) {FAILED} AS bad FROM {WARM} GROUP BY ALL)""",
    "vib_overall": f"SELECT {spread('vibration_mm_s', 'vibration')} FROM readings",
    "vib_by_type": f"""
      SELECT equipment_type, {spread('vibration_mm_s', 'vibration')},
        {dec("stddev_samp(vibration_mm_s) / nullif(avg(vibration_mm_s), 0) * 100")} AS coefficient_variation
      FROM {SHAKING} GROUP BY ALL""",
    "vib_by_equipment": f"""
      SELECT equipment_id, equipment_type, plant_area, manufacturer,
        {r("avg(vibration_mm_s)", "avg_vibration")}, {r("max(vibration_mm_s)", "max_vibration")},
        {r(f"avg(vibration_mm_s) {FAILED}", "avg_vib_at_failure")}
      FROM {SHAKING} GROUP BY ALL""",
    "vib_normal_vs_failure": f"""
      SELECT equipment_type, {r("normal", "avg_vib_normal")}, {r("bad", "avg_vib_failure")},
        {dec("(bad - normal) * 100 / nullif(normal, 0)")} AS vib_increase_pct
      FROM (SELECT equipment_type, avg(vibration_mm_s) FILTER (WHERE failure_flag = 0) AS normal,
              avg(vibration_mm_s) {FAILED} AS bad FROM {SHAKING} GROUP BY ALL)""",
    "vib_alerts": f"""
      SELECT equipment_id, equipment_type, timestamp, vibration_mm_s,
        {r("bound", "upper_threshold")}, failure_flag
      FROM (SELECT *, avg(vibration_mm_s) OVER kind + 2 * stddev_samp(vibration_mm_s) OVER kind AS bound
            FROM readings WINDOW kind AS (PARTITION BY equipment_type))
      WHERE vibration_mm_s > bound""",
}

HEALTH = {
    "health_index_by_equipment": f"""
      SELECT equipment_id, equipment_type, {r("t", "avg_temp_score")}, {r("v", "avg_vib_score")},
        {r("e", "avg_eff_score")}, {r("k", "avg_risk_score")},
        {dec("100 - (t + v + e + k) / 4")} AS health_index,
        CASE WHEN t + v + e + k <= 80 THEN 'Excellent' WHEN t + v + e + k <= 160 THEN 'Good'
             WHEN t + v + e + k <= 240 THEN 'Fair' WHEN t + v + e + k <= 320 THEN 'Poor'
             ELSE 'Critical' END AS health_status,
        failure_count
      FROM (
        SELECT equipment_id, equipment_type,
          avg(CASE WHEN temperature_c >= 100 THEN 100 ELSE greatest(temperature_c - 50, 0) * 2 END) AS t,
          avg(CASE WHEN vibration_mm_s >= 20 THEN 100e0
                   ELSE greatest(vibration_mm_s - 2, 0) * 5.56e0 END) AS v,
          avg(100 - coalesce(efficiency_percent, 80)) AS e,
          avg(CASE failure_risk_level WHEN 'High' THEN 100 WHEN 'Medium' THEN 50 WHEN 'Low' THEN 0
                ELSE 25 END) AS k,
          CAST(sum(failure_flag) AS BIGINT) AS failure_count
        FROM readings WHERE temperature_c + vibration_mm_s IS NOT NULL GROUP BY ALL)""",
    "health_index_by_type": f"""
      SELECT equipment_type, {SEEN} AS equipment_count, {r("avg(efficiency_percent)", "avg_efficiency")},
        {r("avg(temperature_c)", "avg_temp")}, {r("avg(vibration_mm_s)", "avg_vibration")},
        {pct(f"count(*) {FAILED}", "count(*)")} AS failure_rate,
        {dec("avg(efficiency_percent) - avg(temperature_c) / 2 - avg(vibration_mm_s) * 2")} AS health_index
      FROM readings WHERE temperature_c + vibration_mm_s + efficiency_percent IS NOT NULL
      GROUP BY ALL""",
}

PROBABILITY = {
    "failure_probability_historical": f"""
      SELECT equipment_id, total_records, failure_count,
        {pct("failure_count", "total_records")} AS historical_failure_probability_pct,
        avg_temp, avg_vib, avg_efficiency,
        CASE WHEN failure_count * 10 >= total_records THEN 'Very High'
             WHEN failure_count * 20 >= total_records THEN 'High'
             WHEN failure_count * 50 >= total_records THEN 'Medium'
             ELSE 'Low' END AS predicted_risk_category
      FROM (SELECT equipment_id, count(*) AS total_records, count(*) {FAILED} AS failure_count,
              {r("avg(temperature_c)", "avg_temp")}, {r("avg(vibration_mm_s)", "avg_vib")},
              {r("avg(efficiency_percent)", "avg_efficiency")}
            FROM readings GROUP BY ALL)""",
    "failure_probability_by_condition": f"""
      , banded AS (
        SELECT equipment_type, failure_flag,
          concat(CASE WHEN temperature_c < 60 THEN 'Normal' WHEN temperature_c < 80 THEN 'Medium'
                   ELSE 'High' END, ' Temp') AS temp_category,
          concat(CASE WHEN vibration_mm_s < 5 THEN 'Normal' WHEN vibration_mm_s < 10 THEN 'Medium'
                   ELSE 'High' END, ' Vibration') AS vib_category
        FROM readings WHERE temperature_c + vibration_mm_s IS NOT NULL)
      SELECT equipment_type, temp_category, vib_category,
        {FAILURE_RATE.replace("failure_rate_pct", "failure_probability_pct")}
      FROM banded GROUP BY ALL""",
    "failure_probability_current": f"""
      , rates AS (
        SELECT equipment_type, {pct(f"count(*) {FAILED}", "count(*)")} AS baseline_failure_rate
        FROM readings GROUP BY ALL),
      newest AS (
        SELECT * FROM readings QUALIFY row_number() OVER (
          PARTITION BY equipment_id ORDER BY timestamp DESC NULLS LAST, record_id DESC NULLS LAST) = 1)
      SELECT equipment_id, equipment_type, temperature_c AS current_temp,
        vibration_mm_s AS current_vibration, efficiency_percent AS current_efficiency,
        failure_risk_level AS current_risk_level, baseline_failure_rate,
        CAST(baseline_failure_rate * CASE failure_risk_level WHEN 'High' THEN 3.0 WHEN 'Medium' THEN 1.5
               ELSE 0.5 END AS DECIMAL(10,3)) AS adjusted_failure_probability_pct
      FROM newest JOIN rates USING (equipment_type)""",
}

RISK = {
    "risk_distribution": f"""
      SELECT failure_risk_level, record_count, equipment_count,
        {pct("record_count", "sum(record_count) OVER ()")} AS percentage
      FROM (SELECT failure_risk_level, count(*) AS record_count, {SEEN} AS equipment_count
            FROM {RATED} GROUP BY ALL)""",
    "risk_distribution_by_type": f"""
      SELECT equipment_type, failure_risk_level, record_count, equipment_count,
        {pct("record_count", "sum(record_count) OVER (PARTITION BY equipment_type)")}
          AS percentage_within_type
      FROM (SELECT equipment_type, failure_risk_level, count(*) AS record_count,
              {SEEN} AS equipment_count FROM {RATED} GROUP BY ALL)""",
    "risk_distribution_by_area": f"""
      SELECT plant_area, failure_risk_level, record_count, equipment_count,
        {pct("record_count", "sum(record_count) OVER (PARTITION BY plant_area)")}
          AS percentage_within_area
      FROM (SELECT plant_area, failure_risk_level, count(*) AS record_count,
              {SEEN} AS equipment_count FROM {RATED} GROUP BY ALL)""",
    "risk_trend_monthly": f"""
      SELECT {MONTH}, failure_risk_level, {SEEN} AS equipment_count, count(*) AS record_count
      FROM {RATED} GROUP BY 1, 2, 3""",
}

DOWNTIME = {
    "downtime_overall": f"""
      SELECT {MINUTES}, {HOURS}, {dec("sum(downtime_minutes) / 1440")} AS total_downtime_days,
        count(*) AS total_failure_events, {PER_FAILURE}
      FROM {REPAIRS}""",
    "downtime_by_type": f"""
      SELECT equipment_type, {MINUTES}, {HOURS}, count(*) AS failure_count, {PER_FAILURE}, {LEAST}, {MOST}
      FROM {REPAIRS} GROUP BY ALL""",
    "downtime_by_area": f"""
      SELECT plant_area, {MINUTES}, {HOURS}, {SEEN} AS affected_equipment, count(*) AS failure_count
      FROM {REPAIRS} GROUP BY ALL""",
    "downtime_monthly": f"""
      SELECT {MONTH}, {MINUTES}, {HOURS}, count(*) AS failure_count, {r(MEAN, "avg_downtime")}
      FROM {REPAIRS} GROUP BY 1, 2""",
    "downtime_by_failure_type": f"""
      SELECT failure_type, {MINUTES}, {HOURS}, count(*) AS occurrence_count,
        {r(MEAN, "avg_downtime_per_occurrence")},
        {dec("sum(downtime_minutes) * 100 / (SELECT sum(downtime_minutes) FROM readings WHERE failure_flag = 1)")}
          AS percentage_of_total_downtime
      FROM {REPAIRS} GROUP BY ALL HAVING failure_type IS NOT NULL""",
    "downtime_by_equipment": f"""
      SELECT equipment_id, equipment_type, plant_area, manufacturer, {MINUTES}, {HOURS},
        count(*) AS failure_count, {PER_FAILURE}, {LEAST}, {MOST},
        max(timestamp) AS last_failure_timestamp
      FROM {REPAIRS} GROUP BY ALL""",
    "downtime_top10": f"""
      SELECT equipment_id, equipment_type, plant_area, {MINUTES}, {HOURS}, count(*) AS failure_count,
        {PER_FAILURE}
      FROM {REPAIRS} GROUP BY ALL
      ORDER BY total_downtime_minutes DESC, equipment_id, equipment_type, plant_area LIMIT 10""",
    "downtime_worst_average": f"""
      SELECT equipment_id, equipment_type, plant_area, count(*) AS failure_count, {PER_FAILURE},
        {MINUTES}, {MEAN_HOURS} AS avg_downtime_hours
      FROM {REPAIRS} GROUP BY ALL HAVING count(*) > 2""",
    "downtime_vs_benchmark": f"""
      , machines AS (
        SELECT equipment_id, equipment_type, sum(downtime_minutes) AS total, {MEAN} AS mean
        FROM {REPAIRS} GROUP BY ALL),
      compared AS (
        SELECT *, avg(total) OVER kind AS usual, avg(mean) OVER kind AS usual_mean
        FROM machines WINDOW kind AS (PARTITION BY equipment_type))
      SELECT equipment_id, equipment_type, {r("total", "equipment_total_downtime")},
        {r("mean", "equipment_avg_downtime")}, {r("usual", "type_benchmark_total")},
        {r("usual_mean", "type_benchmark_avg")},
        {dec("(total - usual) * 100 / nullif(usual, 0)")} AS variance_from_benchmark_pct,
        CASE WHEN total > usual * 1.5e0 THEN 'Critical' WHEN total > usual * 1.2e0 THEN 'Above Average'
             WHEN total < usual * 0.8e0 THEN 'Below Average' ELSE 'Average' END AS performance_category
      FROM compared WHERE equipment_type IS NOT NULL""",
}

DASHBOARD = {
    "dashboard_executive": f"""
      SELECT 'Overall Performance' AS metric_category, {SEEN} AS total_equipment,
        {pct(f"count(*) {FAILED}", "count(*)")} AS failure_rate_pct,
        {dec(f"sum(operating_hours) / nullif(count(*) {FAILED}, 0)")} AS mtbf_hours,
        {dec(f"avg(downtime_minutes) {FAILED} / 60")} AS mttr_hours,
        {SEEN} {RISKY} AS high_risk_equipment, {pct(f"count(*) {RISKY}", "count(*)")} AS high_risk_pct,
        {dec("avg(temperature_c)")} AS avg_temperature, {dec("avg(vibration_mm_s)")} AS avg_vibration,
        {dec("avg(efficiency_percent)")} AS avg_efficiency,
        {dec(f"sum(downtime_minutes) {FAILED} / 60")} AS total_downtime_hours,
        count(*) {FAILED} AS total_failures,
        {dec("sum(energy_consumption_kwh)")} AS total_energy_consumption
      FROM readings""",
    "dashboard_by_type": f"""
      SELECT equipment_type, {SEEN} AS equipment_count,
        {pct(f"count(*) {FAILED}", "count(*)")} AS failure_rate_pct,
        {dec(f"avg(downtime_minutes) {FAILED}")} AS avg_mttr_minutes,
        {SEEN} {RISKY} AS high_risk_count,
        {dec("avg(temperature_c)")} AS avg_temp, {dec("avg(vibration_mm_s)")} AS avg_vibration,
        {dec(f"sum(downtime_minutes) {FAILED} / 60")} AS total_downtime_hours
      FROM readings GROUP BY ALL HAVING equipment_type IS NOT NULL""",
}

MAINTENANCE = {
    "planned_unplanned_ratio": f"""
      SELECT equipment_type, planned_count, unplanned_count,
        {r("planned_count / nullif(unplanned_count, 0)", "planned_unplanned_ratio")}
      FROM (SELECT equipment_type,
              count(*) FILTER (WHERE maintenance_type IN ('Preventive', 'Predictive')) AS planned_count,
              count(*) FILTER (WHERE maintenance_type = 'Corrective') AS unplanned_count
            FROM readings GROUP BY ALL)""",
    "maintenance_frequency": f"""
      SELECT equipment_id, {MONTH}, count(maintenance_type) AS maintenance_count
      FROM readings GROUP BY 1, 2, 3 HAVING count(maintenance_type) > 0""",
    "failure_trend_by_machine": f"""
      SELECT equipment_id, {MONTH}, count(*) {FAILED} AS failure_count
      FROM readings GROUP BY 1, 2, 3 HAVING count(*) {FAILED} > 0""",
    # Gaps taken one by one, where the Spark job uses the span of the failures.
    "remaining_useful_life": f"""
      , gaps AS (
        SELECT equipment_id, timestamp,
          epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY equipment_id ORDER BY timestamp))
            AS gap
        FROM readings WHERE failure_flag = 1 AND timestamp IS NOT NULL),
      lives AS (
        SELECT equipment_id, count(*) AS failure_count, avg(gap) / 3.6e9 AS mean_gap,
          max(timestamp) AS last_failure FROM gaps GROUP BY ALL HAVING count(*) > 1),
      now AS (SELECT equipment_id, max(timestamp) AS last_reading FROM readings GROUP BY ALL),
      ages AS (
        SELECT *, (epoch_us(last_reading) - epoch_us(last_failure)) / 3.6e9 AS age
        FROM lives JOIN now USING (equipment_id))
      SELECT equipment_id, failure_count, {r("mean_gap", "mean_hours_between_failures")},
        {r("age", "hours_since_last_failure")},
        {r("greatest(mean_gap - age, 0)", "remaining_useful_life_hours")}
      FROM ages""",
}

SOURCES = {
    "source_table": "SELECT shift, count(*) AS reading_count FROM readings GROUP BY ALL",
    "sink_parquet": "SELECT * FROM readings",
    "preview_rows": "SELECT * FROM readings ORDER BY record_id NULLS LAST LIMIT 5",
    "preview_shape": "SELECT count(*) AS row_count, 22 AS column_count FROM readings",
}

ON_READINGS = {
    **QUALITY, **RELIABILITY, **REPAIR, **HIGH_RISK, **SENSORS, **HEALTH, **PROBABILITY, **RISK,
    **DOWNTIME, **DASHBOARD, **MAINTENANCE, **SOURCES,
}
