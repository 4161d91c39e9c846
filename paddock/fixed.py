"""Fixed values that results depend on."""

# Compound codes, the tyre model each compound uses, and the sets the
# safety-car rules need.
COMPOUND_CODES = {"HARD": 0, "INTERMEDIATE": 1, "MEDIUM": 2, "SOFT": 3, "WET": 4}
COMPOUND_MODELS = {
    "SOFT": "soft", "MEDIUM": "medium", "HARD": "hard", "INTERMEDIATE": "inter", "WET": "wet",
}
DEFAULT_COMPOUND = "MEDIUM"
STOP_COMPOUNDS = ("SOFT", "MEDIUM", "HARD")
WET_COMPOUNDS = ("INTERMEDIATE", "WET")
STREET_CIRCUITS = (
    "Circuit de Monaco",
    "Baku City Circuit",
    "Marina Bay Street Circuit",
    "Jeddah Corniche Circuit",
    "Las Vegas Strip Circuit",
)

# Model and search constants.
START_FUEL_KG = 110.0
FUEL_SECONDS_PER_KG = 0.03
DEFAULT_TRACK_TEMP = 35.0
DEFAULT_AIR_TEMP = 25.0
DEGRADED_SECONDS = 1.5
LIFE_LAPS = 40
PIT_STOP_SECONDS = 22.0
LAP_NOISE_SECONDS = 0.35
MAX_GAP_SECONDS = 120.0
PIT_LOOKAHEAD = 15
PIT_HORIZON = 15
PIT_CROSSING = 0.65
PIT_ALERT = 0.5
UNDERCUT_ALERT = 0.5
UNDERCUT_LAPS = 5
SC_LAP1, SC_WET, SC_STREET = 2.5, 3.0, 1.8
SC_HORIZONS = (1, 2, 3, 5, 10)
SC_MIN_ROWS = 200
TRAIN_FIRST_SEASON, TRAIN_LAST_SEASON, HOLDOUT_SEASON = 2018, 2024, 2025
ROUNDS = range(1, 25)
CAR_SECONDS, WEATHER_SECONDS = 8, 60

# Feature columns in model order and their labels.
TYRE_FEATURES = (
    "lap_number", "compound_encoded", "tyre_age_laps", "fuel_adjusted_time",
    "circuit_id_encoded", "driver_id_encoded",
)
PIT_FEATURES = (
    "current_tyre_age", "predicted_life_remaining", "gap_to_car_ahead", "gap_to_car_behind",
    "safety_car_probability", "laps_to_race_end", "position", "fuel_load_est",
)
STYLE_FEATURES = (
    "sector_time_variance", "tyre_management_index", "lap_time_consistency",
    "stint_length_tendency",
)
FEATURE_LABELS = {
    "lap_number": "Lap number",
    "compound_encoded": "Tyre compound",
    "tyre_age_laps": "Tyre age",
    "fuel_adjusted_time": "Fuel-adjusted pace",
    "circuit_id_encoded": "Circuit",
    "driver_id_encoded": "Driver",
    "current_tyre_age": "Tyre age",
    "predicted_life_remaining": "Predicted tyre life remaining",
    "gap_to_car_ahead": "Gap to car ahead",
    "gap_to_car_behind": "Gap to car behind",
    "safety_car_probability": "Safety car probability",
    "laps_to_race_end": "Laps to race end",
    "position": "Track position",
    "fuel_load_est": "Estimated fuel load",
}

# Live feed channel numbers and DRS codes.
CHANNELS = {"2": "speed_kmh", "3": "gear", "4": "throttle_pct", "5": "brake", "45": "drs"}
DRS_CODES = {0: "off", 8: "available", 10: "enabled", 14: "open"}
FEED_TOPICS = ("CarData.z", "TimingData", "WeatherData")

# Alert and session types.
ALERT_TYPES = (
    "PIT_WINDOW_OPEN", "UNDERCUT_THREAT", "SAFETY_CAR_PROBABILITY", "FASTEST_LAP_THREAT",
    "COMPETITOR_PITTED",
)
SESSION_COLUMNS = {
    "FP1": ("fp1Date", "fp1Time"),
    "FP2": ("fp2Date", "fp2Time"),
    "FP3": ("fp3Date", "fp3Time"),
    "Q": ("qualifyingDate", "qualifyingTime"),
    "R": ("raceDate", "raceTime"),
}

# Event location -> circuit name.
LOCATIONS = {
    "Sakhir": "Bahrain International Circuit",
    "Jeddah": "Jeddah Corniche Circuit",
    "Melbourne": "Albert Park Circuit",
    "Suzuka": "Suzuka Circuit",
    "Shanghai": "Shanghai International Circuit",
    "Miami": "Miami International Autodrome",
    "Miami Gardens": "Miami International Autodrome",
    "Imola": "Autodromo Enzo e Dino Ferrari",
    "Monaco": "Circuit de Monaco",
    "Barcelona": "Circuit de Barcelona-Catalunya",
    "Montréal": "Circuit Gilles Villeneuve",
    "Montreal": "Circuit Gilles Villeneuve",
    "Spielberg": "Red Bull Ring",
    "Silverstone": "Silverstone Circuit",
    "Budapest": "Hungaroring",
    "Spa-Francorchamps": "Circuit de Spa-Francorchamps",
    "Zandvoort": "Circuit Zandvoort",
    "Monza": "Autodromo Nazionale Monza",
    "Baku": "Baku City Circuit",
    "Singapore": "Marina Bay Street Circuit",
    "Marina Bay": "Marina Bay Street Circuit",
    "Austin": "Circuit of the Americas",
    "Mexico City": "Autodromo Hermanos Rodriguez",
    "São Paulo": "Autodromo Jose Carlos Pace",
    "Sao Paulo": "Autodromo Jose Carlos Pace",
    "Las Vegas": "Las Vegas Strip Circuit",
    "Lusail": "Lusail International Circuit",
    "Yas Island": "Yas Marina Circuit",
    "Abu Dhabi": "Yas Marina Circuit",
}

# Circuit seed rows (name, country, track length in km, lap record in s).
CIRCUITS = (
    ("Bahrain International Circuit", "Bahrain", 5.412, 92.877),
    ("Jeddah Corniche Circuit", "Saudi Arabia", 6.174, 90.734),
    ("Albert Park Circuit", "Australia", 5.278, 80.235),
    ("Suzuka Circuit", "Japan", 5.807, 91.846),
    ("Shanghai International Circuit", "China", 5.451, 96.093),
    ("Miami International Autodrome", "United States", 5.412, 90.584),
    ("Autodromo Enzo e Dino Ferrari", "Italy", 4.909, 75.476),
    ("Circuit de Monaco", "Monaco", 3.337, 74.260),
    ("Circuit de Barcelona-Catalunya", "Spain", 4.657, 79.252),
    ("Circuit Gilles Villeneuve", "Canada", 4.361, 73.078),
    ("Red Bull Ring", "Austria", 4.318, 64.736),
    ("Silverstone Circuit", "United Kingdom", 5.891, 87.097),
    ("Hungaroring", "Hungary", 4.381, 76.627),
    ("Circuit de Spa-Francorchamps", "Belgium", 7.004, 105.829),
    ("Circuit Zandvoort", "Netherlands", 4.259, 72.097),
    ("Autodromo Nazionale Monza", "Italy", 5.793, 80.827),
    ("Baku City Circuit", "Azerbaijan", 6.003, 105.491),
    ("Marina Bay Street Circuit", "Singapore", 5.063, 95.019),
    ("Circuit of the Americas", "United States", 5.513, 95.395),
    ("Autodromo Hermanos Rodriguez", "Mexico", 4.304, 79.246),
    ("Autodromo Jose Carlos Pace", "Brazil", 4.309, 71.168),
    ("Las Vegas Strip Circuit", "United States", 6.201, None),
    ("Lusail International Circuit", "Qatar", 5.380, 83.196),
    ("Yas Marina Circuit", "Abu Dhabi", 5.281, 87.789),
)
