"""Table schemas as DDL text; every column is nullable."""

from __future__ import annotations

TABLES: dict[str, str] = {
    "circuits": (
        "id string, name string, country string, track_length_km double, "
        "lap_record_seconds double, created_at timestamp"
    ),
    "races": (
        "id string, season int, round_number int, circuit_id string, race_date date, "
        "weather string, status string"
    ),
    "sessions": ("id string, race_id string, session_type string, session_date date"),
    "drivers": (
        "id string, code string, full_name string, nationality string, date_of_birth date"
    ),
    "teams": ("id string, name string, constructor_id string, color_hex string"),
    "driver_contracts": ("id string, driver_id string, team_id string, season int"),
    "lap_data": (
        "id string, session_id string, driver_id string, lap_number int, "
        "lap_time_seconds double, compound string, tyre_age_laps int, is_valid boolean, "
        "position int, track_status string, sector1_seconds double, sector2_seconds double, "
        "sector3_seconds double, track_temp double, air_temp double, created_at timestamp"
    ),
    "tire_stints": (
        "id string, session_id string, driver_id string, stint_number int, compound string, "
        "start_lap int, end_lap int, avg_deg_per_lap double"
    ),
    "sector_times": (
        "id string, lap_data_id string, sector int, time_seconds double, "
        "mini_sector_speeds array<double>"
    ),
    "strategy_predictions": (
        "id string, session_id string, driver_id string, predicted_at timestamp, "
        "optimal_pit_lap int, pit_probability double, undercut_score double, "
        "overcut_score double, tire_life_remaining double, confidence_score double, "
        "model_version string, created_at timestamp"
    ),
    "pit_events": (
        "id string, session_id string, driver_id string, lap_number int, compound_in string, "
        "compound_out string, pit_duration_seconds double, was_predicted boolean"
    ),
    "users": (
        "id string, email string, full_name string, is_active boolean, created_at timestamp, "
        "subscription_tier string, fcm_token string"
    ),
    "alerts": (
        "id string, user_id string, session_id string, alert_type string, driver_id string, "
        "message string, triggered_at timestamp, delivered_at timestamp, read_at timestamp"
    ),
    "subscriptions": (
        "id string, user_id string, driver_ids array<string>, team_ids array<string>, "
        "alert_types array<string>"
    ),
    "raw_laps": (
        "Driver string, LapNumber double, LapTime interval day to second, "
        "Sector1Time interval day to second, Sector2Time interval day to second, "
        "Sector3Time interval day to second, Compound string, TyreLife double, "
        "IsAccurate boolean, Position double, TrackStatus string, Stint double, "
        "Time interval day to second"
    ),
    "model_registry": (
        "model_name string, version string, holdout_mae double, cv_mae double, "
        "promotion_basis string, path string, promoted boolean"
    ),
}

TIMING = (
    "Lines map<string, struct<NumberOfLaps: int, LastLapTime: struct<Value: string>, "
    "Sectors: map<string, struct<Value: string>>>>"
)
CARS = ("Cars map<string, struct<Channels: map<string, double>>>")
WEATHER = ("TrackTemp string, AirTemp string")
CAR_ENTRY = ("Channels map<string, double>")
PREDICTION_MESSAGE = (
    "session_id string, driver_id string, optimal_pit_lap int, pit_probability double, "
    "undercut_score double, overcut_score double, tire_life_remaining double, "
    "confidence_score double, model_version string"
)
