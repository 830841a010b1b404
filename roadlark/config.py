"""Thresholds and vocabularies of the domain, in one place. Fixed values."""

from __future__ import annotations

RULES = ("no_parking", "wrong_way", "illegal_u_turn", "red_light", "speeding", "lane", "zebra_crossing", "no_helmet", "overloading", "highway_stop")
#: Percent; reported beside an event, never a gate.
RULE_CONFIDENCE = {"no_parking": 90, "wrong_way": 85, "illegal_u_turn": 82, "red_light": 92, "speeding": 85, "lane": 80, "zebra_crossing": 85, "no_helmet": 80, "overloading": 78, "highway_stop": 88}
ANOMALIES = ("pothole", "crack", "waterlogging", "debris")
STATUSES = ("flagged", "reviewed", "actioned", "resolved", "dismissed")
#: Allowed changes of an event's status.
TRANSITIONS = (("flagged", "reviewed"), ("flagged", "duplicate"), ("flagged", "dropped"), ("reviewed", "actioned"), ("reviewed", "dismissed"), ("actioned", "resolved"))
ROLES = ("OFFICER", "OPERATOR", "PLANNER", "MAINTENANCE", "ADMIN")
#: Who may do what.
PERMISSIONS = {
    "view_violations": ("OFFICER", "OPERATOR", "ADMIN"),
    "update_violations": ("OFFICER", "ADMIN"),
    "dismiss_violations": ("OFFICER", "ADMIN"),
    "view_anomalies": ("OPERATOR", "PLANNER", "MAINTENANCE", "ADMIN"),
    "update_anomalies": ("MAINTENANCE", "ADMIN"),
    "view_twin": ("OFFICER", "OPERATOR", "PLANNER", "ADMIN"),
    "run_session": ("OPERATOR", "ADMIN"),
    "edit_zones": ("PLANNER", "ADMIN"),
    "run_scenarios": ("PLANNER", "ADMIN"),
    "export_reports": ("PLANNER", "MAINTENANCE", "ADMIN"),
    "manage_users": ("ADMIN",),
}
EMERGENCY = ("ambulance", "fire_truck")
EARTH_M = 6371008.8

PARKED_KMH, PARKING_GRACE_S = 2.0, 30
WRONG_WAY_DEG, WRONG_WAY_FRAMES = 150.0, 5
U_TURN_DEG, U_TURN_SMOOTHNESS = 160.0, 0.5
SPEEDING_FRAMES = 10
LANE_S = 3
ZEBRA_S = 10
HELMET_CONFIDENCE = 0.80
PASSENGERS = 3
HIGHWAY_KMH, HIGHWAY_S = 5.0, 20
BUFFER_FRAMES, HISTORY_FRAMES = 30, 10
OCCLUSION_S, ABORT_S, HEARTBEAT_S, CATCH_UP_S = 5, 60, 5, 60
LOW_LIGHT, WEATHER = 0.60, 0.50
ALTITUDE_WARN_M, ALTITUDE_LIMIT_M = 110.0, 120.0
DISMISSAL_RATE, DENSITY = 0.20, 80
DUPLICATE_M, DUPLICATE_S = 10.0, 5
DEDUP_M, PROMOTE_SESSIONS = 3.0, 2
ZONE_BUFFER_M, LOW_F1 = 2.0, 0.65
TTL_S = {"vehicle": 30, "session": 60, "telemetry": 10}
CLUSTER_M, CLUSTER_MIN, RECOMMEND_MIN = 50.0, 10, 50
RETENTION_DAYS = 730
SEVERITY_CUTS = (0.33, 0.66)
CLASS_WEIGHTS = {"pothole": 1.0, "crack": 0.8, "waterlogging": 0.9, "debris": 0.7}
#: change -> (event type, low, middle, high share of events avoided)
IMPACT = {
    "signal": ("red_light", 0.70, 0.75, 0.80),
    "speed_bump": ("speeding", 0.55, 0.65, 0.75),
    "one_way": ("wrong_way", 0.80, 0.89, 0.95),
    "marking": ("lane", 0.40, 0.50, 0.60),
}
#: event type, least share of a cluster, recommendation, further measure, what must hold for the place
RECOMMENDATIONS = (
    ("red_light", 0.40, "signal", "traffic signal", ("at_intersection",)),
    ("speeding", 0.40, "speed_bump", "speed bump and advisory signage", ("near_school",)),
    ("wrong_way", 0.40, "one_way", "one-way conversion and barriers", ()),
    ("lane", 0.50, "signage", "marking refresh and rumble strips", ("multi_lane",)),
    ("pothole", 0.40, "resurfacing", "priority resurfacing", ("arterial", "mostly_high")),
    ("waterlogging", 0.40, "drainage", "drainage improvement", ("chronic",)),
)
