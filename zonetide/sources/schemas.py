"""Explicit schemas: no source is inferred."""

ZONES = "zone_id int, zone_name string, region string, lat double, lon double, zone_type string"
PINGS = "lat double, lon double, timestamp timestamp"
SNAPSHOT = "zone_id int, zone_name string, region string, zone_type string, taxi_count int, timestamp timestamp"
SNAPSHOT_TEXT = "zone_id string, zone_name string, region string, zone_type string, taxi_count string, timestamp string"
CARPARK_PAYLOAD = ("value array<struct<CarParkID:string,Area:string,Development:string,Location:string,"
                   "AvailableLots:string,LotType:string,Agency:string>>")
TRAVEL_PAYLOAD = ("value array<struct<Name:string,Direction:string,FarEndPoint:string,StartPoint:string,"
                  "EndPoint:string,EstTime:string>>")
WEATHER_PAYLOAD = ("hourly struct<time:array<string>,temperature_2m:array<double>,precipitation:array<double>,"
                   "weathercode:array<int>,windspeed_10m:array<double>>")
STATION_PAYLOAD = "items array<struct<readings:array<struct<station_id:string,value:double>>>>"
HOLIDAY_PAYLOAD = "result struct<records:array<struct<date:string,holiday_name:string>>>"
HOLIDAY_ROW = "date string, holiday_name string"
ADJACENCY = "zone string, neighbors array<string>"
RUN_LOG = ("run_id string, timestamp string, rows_scored long, failed_rows long, flagged_zones long, drift_flag boolean, "
           "rollback_status boolean, model_version string, run_status string, latency_ms long, avg_delay_min double, "
           "fulfilment_rate double, total_taxi_count long, high_risk_zones_now long, supply_now long, "
           "rapid_depletion_zones long, avg_demand_pressure_score double, avg_imbalance_score double, "
           "feature_nan_count long, psi double, logged_at string")
ALERT_LOG = "alert_id string, severity string, message string, zone_id int, created_at string"
AUDIT_LOG = "event string, from_version string, to_version string, reason string, run_id string, timestamp string"
SCORE_HISTORY = "timestamp string, zones map<string,string>, taxi_counts map<string,string>"
OUTCOME_LOG = (
    "recommendation_id string, action_id string, zone_id int, zone_name string, action_type string, pricing_level string, "
    "incentive_level string, push_level string, priority string, score_at_time double, supply_at_time int, risk_level string, "
    "root_cause string, intervention_window string, eta_bucket string, adjacent_risk_flag boolean, estimated_cost_sgd double, "
    "logged_at string, check_after string, evaluation_bucket string, outcome string, score_after double, supply_after_30m int, "
    "supply_delta_30m int, followed_status string, followed_at string, followed_by string, follow_note string")
VERSION_EVENTS = ("version_id string, status string, at timestamp, seq int, trained_at timestamp, promoted_at timestamp, "
                  "precision double, recall double, f1 double, roc_auc double")
