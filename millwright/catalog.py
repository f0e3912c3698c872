"""All measures by name, grouped by the table they run on."""

from .plans import (
    dashboard, downtime, health, maintenance, quality, reliability, reports, risk, sensors,
)

ON_READINGS = {
    "dq_completeness": quality.completeness,
    "dq_null_sensors": quality.null_sensors,
    "dq_duplicate_readings": quality.duplicate_readings,
    "dq_duplicate_record_ids": quality.duplicate_record_ids,
    "dq_out_of_range_sensors": quality.out_of_range_sensors,
    "dq_illogical_hours": quality.illogical_hours,
    "dq_failure_consistency": quality.failure_consistency,
    "dq_temp_outliers": quality.temp_outliers,
    "dq_vibration_outliers": quality.vibration_outliers,
    "failure_rate_overall": reliability.failure_rate_overall,
    "failure_rate_by_type": reliability.failure_rate_by_type,
    "failure_rate_by_equipment": reliability.failure_rate_by_equipment,
    "failure_rate_monthly": reliability.failure_rate_monthly,
    "failure_rate_by_shift": reliability.failure_rate_by_shift,
    "mtbf_by_equipment": reliability.mtbf_by_equipment,
    "mtbf_by_type": reliability.mtbf_by_type,
    "mtbf_by_area": reliability.mtbf_by_area,
    "mttr_by_type": downtime.mttr_by_type,
    "mttr_by_equipment": downtime.mttr_by_equipment,
    "mttr_by_failure_type": downtime.mttr_by_failure_type,
    "mttr_monthly": downtime.mttr_monthly,
    "high_risk_count": risk.high_risk_count,
    "high_risk_by_type_area": risk.high_risk_by_type_area,
    "high_risk_equipment_detail": risk.high_risk_equipment_detail,
    "high_risk_monthly": risk.high_risk_monthly,
    "temp_overall": sensors.temp_overall,
    "temp_by_type": sensors.temp_by_type,
    "temp_by_equipment": sensors.temp_by_equipment,
    "temp_daily_trend": sensors.temp_daily_trend,
    "temp_normal_vs_failure": sensors.temp_normal_vs_failure,
    "vib_overall": sensors.vib_overall,
    "vib_by_type": sensors.vib_by_type,
    "vib_by_equipment": sensors.vib_by_equipment,
    "vib_normal_vs_failure": sensors.vib_normal_vs_failure,
    "vib_alerts": sensors.vib_alerts,
    "health_index_by_equipment": health.health_index_by_equipment,
    "health_index_by_type": health.health_index_by_type,
    "failure_probability_historical": risk.failure_probability_historical,
    "failure_probability_by_condition": risk.failure_probability_by_condition,
    "failure_probability_current": risk.failure_probability_current,
    "risk_distribution": risk.risk_distribution,
    "risk_distribution_by_type": risk.risk_distribution_by_type,
    "risk_distribution_by_area": risk.risk_distribution_by_area,
    "risk_trend_monthly": risk.risk_trend_monthly,
    "downtime_overall": downtime.downtime_overall,
    "downtime_by_type": downtime.downtime_by_type,
    "downtime_by_area": downtime.downtime_by_area,
    "downtime_monthly": downtime.downtime_monthly,
    "downtime_by_failure_type": downtime.downtime_by_failure_type,
    "downtime_by_equipment": downtime.downtime_by_equipment,
    "downtime_top10": downtime.downtime_top10,
    "downtime_worst_average": downtime.downtime_worst_average,
    "downtime_vs_benchmark": downtime.downtime_vs_benchmark,
    "dashboard_executive": dashboard.dashboard_executive,
    "dashboard_by_type": dashboard.dashboard_by_type,
    "planned_unplanned_ratio": maintenance.planned_unplanned_ratio,
    "maintenance_frequency": maintenance.maintenance_frequency,
    "failure_trend_by_machine": maintenance.failure_trend_by_machine,
    "remaining_useful_life": maintenance.remaining_useful_life,
}

ON_FEATURES = {
    "overall_kpis": reports.overall_kpis,
    "risk_distribution_features": reports.risk_distribution_features,
    "downtime_per_equipment": reports.downtime_per_equipment,
    "equipment_health": reports.equipment_health,
    "failure_analysis": reports.failure_analysis,
    "monthly_trends": reports.monthly_trends,
    "equipment_type_kpis": reports.equipment_type_kpis,
    "predictive_alerts": reports.predictive_alerts,
    "most_downtime": reports.most_downtime,
    "least_healthy": reports.least_healthy,
    "latest_months": reports.latest_months,
    "first_alerts": reports.first_alerts,
    "downtime_risk": maintenance.downtime_risk,
}
