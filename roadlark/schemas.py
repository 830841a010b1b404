"""Explicit schemas of stored tables and input streams; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = "struct<lng:double,lat:double>"


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(text)


STORED = {
    "zones": f"id string, name string, zone_type string, geometry array<{POINT}>, speed_limit int, permitted_dir double, grace_period int, is_active boolean, created_by string, created_at timestamp, updated_at timestamp",
    "violation_events": "id string, track_id int, violation_type string, session_id string, lat double, lng double, zone_id string, confidence double, status string, snapshot_url string, velocity double, heading double, flagged_at timestamp, resolved_at timestamp, reviewed_by string",
    "road_anomalies": "id string, anomaly_type string, session_id string, lat double, lng double, zone_id string, severity_score double, severity_band string, area_sq_m double, status string, snapshot_url string, first_detected_at timestamp, last_seen_at timestamp, recurrence_count int, reviewed_by string",
    "vehicle_tracks": f"id string, track_id int, session_id string, trajectory array<{POINT}>, start_time timestamp, end_time timestamp, vehicle_class string, appearance_vec array<float>, created_at timestamp",
    "recommendations": f"id string, cluster_id long, source_type string, rec_type string, geometry array<{POINT}>, description string, supporting_data string, projected_impact double, status string, created_at timestamp",
    "reports": "id string, scope_zone_ids array<string>, date_from date, date_to date, report_type string, file_url string, requested_by string, generated_at timestamp",
    "drone_sessions": f"id string, operator_id string, start_time timestamp, end_time timestamp, patrol_zone array<{POINT}>, max_altitude double, status string",
    "users": "id string, username string, password_hash string, role string, full_name string, badge_number string, is_active boolean, created_at timestamp",
    "audit": "user_id string, role string, action string, resource_id string, ts timestamp, ip_address string, result string",
    "scenarios": f"id string, geometry array<{POINT}>, change_type string, description string, saved_at timestamp",
}
INPUTS = {
    "detections": "session_id string, frame_no int, ts timestamp, det_id long, box struct<x1:double,y1:double,x2:double,y2:double>, vehicle_class string, confidence double",
    "track_points": "session_id string, track_id int, frame_no int, ts timestamp, lat double, lng double, speed_kmh double, heading_deg double, vehicle_class string",
    "defect_masks": "session_id string, frame_no int, ts timestamp, mask_region array<struct<x:double,y:double>>, pixel_area double, confidence double, anomaly_type string",
    "telemetry": "session_id string, ts timestamp, lat double, lng double, alt double, pitch double, roll double, yaw double, gps_fix int",
    "signal_states": "junction_id string, ts timestamp, state string",
    "heartbeat": "session_id string, ts timestamp",
    "responders": "responder_id string, ts timestamp, lat double, lng double",
    "ground_truth": "session_id string, frame_no int, track_id int, lat double, lng double, label string",
}
