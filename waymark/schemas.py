"""Table schemas. All timestamps are UTC."""

POINT = "struct<latitude:double,longitude:double,speed:double,recorded_at:timestamp>"
RINGS = "array<array<array<double>>>"

TABLES = {
    "positions": (
        "id bigint, device_id bigint, recorded_at timestamp, latitude double, longitude double, speed double, "
        "heading double, altitude double, accuracy double, satellites int, metadata string"
    ),
    "devices": (
        "id bigint, device_imei string, vehicle_id bigint, status string, activated_at timestamp, "
        "last_seen timestamp, metadata string, modo int"
    ),
    "device_events": (
        "id bigint, device_id bigint, event_type string, position_id bigint, created_at timestamp, metadata string"
    ),
    "alerts": (
        "id bigint, device_id bigint, alert_type string, severity string, metadata string, "
        "created_at timestamp, resolved boolean"
    ),
    "geofences": (
        "id bigint, vehicle_id bigint, name string, geojson string, active boolean, type string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "risk_zones": "id bigint, name string, geojson string, risk_level double, created_at timestamp",
    "daily_routes": (
        "device_id bigint, date date, point_count bigint, total_distance double, avg_speed double, created_at timestamp"
    ),
    "route_segments": f"device_id bigint, date date, slot int, segment bigint, points array<{POINT}>",
    "anomalies": (
        "id bigint, device_id bigint, latitude double, longitude double, anomaly_score double, "
        "is_anomaly boolean, detected_at timestamp, metadata string"
    ),
    "zones": (
        "device_id bigint, cluster_id int, centroid_lat double, centroid_lng double, density double, radius double, "
        "point_count bigint, label string, updated_at timestamp, created_at timestamp"
    ),
    "models": (
        "id bigint, device_id bigint, model_type string, trained_from date, trained_to date, created_at timestamp"
    ),
    "trained_models": (
        "id bigint, device_id bigint, model_type string, trained_from date, trained_to date, created_at timestamp, "
        "features array<string>, n_samples bigint, means array<double>, deviations array<double>, threshold double"
    ),
    "forests": (
        "device_id bigint, tree int, sample_size int, feature array<int>, threshold array<double>, path array<double>, "
        "model_id bigint, trained_to date"
    ),
    "heatmap": "h3_cell string, lat double, lon double, intensity double, event_count bigint",
}
