"""Default parameters of the jobs. Every job takes them as arguments; these are the defaults."""

# Distances and speeds
EARTH_RADIUS_M = 6_371_000.0
TELEPORT_M = 5000.0
MAX_SPEED_KMH = 250.0
SLOW_SPEED_KMH = 10.0
TELEMETRY_SPEED_KMH = 200.0

# History windows and minimum group sizes
TRAINING_DAYS = 20
SCORING_HOURS = 24
REPORT_HOURS = 168
WEEK_DAYS = 7
HEATMAP_DAYS = 30
MIN_ROUTE_POINTS = 5
MIN_TRAINING_ROWS = 50

# Isolation forest
TREES = 200
SENSOR_TREES = 100
SENSOR_DAYS = 30
TREE_SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42
ROUTE_FEATURES = ("latitude", "longitude", "hour", "speed")
SENSOR_FEATURES = ("speed", "heading", "altitude", "accuracy", "satellites")

# Frequent zones
EPS_M = 150.0
MIN_SAMPLES = 8
MAIN_ZONES = 2

# Real-time score
INSIDE_ZONE_M = 200.0
FAR_M = 5000.0
NEAR_M = 2000.0
FOREST_SCORE = 0.5
SECONDARY_ZONE_SCORE = 0.2
FAR_SCORE = 0.4
NEAR_SCORE = 0.2
ALERT_SCORE = 0.7
RISK_MEDIUM = 0.4
RISK_HIGH = 0.65

# heatmap
HEX_RESOLUTION = 8
WEIGHT_TELEMETRY = 0.1
WEIGHT_CRITICAL = 0.8
WEIGHT_WARNING = 0.4
ZONE_MULTIPLIER = 1.5
ZONE_WEIGHT = 0.5
MIN_INTENSITY = 0.05
TELEMETRY_EVERY = 20

# Report limits
ANOMALY_LIMIT = 500
ANOMALY_LIMIT_MAX = 2000
DEVICE_ANOMALY_LIMIT = 100
HEAT_POINT_LIMIT = 5000
ROUTE_LIMIT = 30
ALERT_LIMIT = 50
POSITION_LIMIT = 100
PEAK_HOURS = 5
NEAR_ZONE_M = 500.0

# Layout: how work is cut into bounded pieces (results do not depend on these)
SEGMENT_POINTS = 1000       # points in one stored route segment
SCORING_CHUNK = 50_000      # points scored by one Python call
PLANNED_LIMIT = 1000        # greatest top-k that Spark limits before a shuffle
TOP_K_SPREAD = 32           # first-stage groups per key in a top-k
ZONES_PER_ROW = 512         # centroids held in one array row
ZONE_CELL_DEGREES = 0.02    # side of the cells that list their possible nearest zones
ZONES_PER_CELL = 32         # zones listed for a cell; one with more is cut into smaller cells
