"""Fixed reference data: events, base times, point tiers, scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed values: (name, distance, stroke); a relay's distance is the team's.
EVENTS = [
    ("50 M Freestyle", 50, "Freestyle"),
    ("100 M Freestyle", 100, "Freestyle"),
    ("200 M Freestyle", 200, "Freestyle"),
    ("400 M Freestyle", 400, "Freestyle"),
    ("800 M Freestyle", 800, "Freestyle"),
    ("1500 M Freestyle", 1500, "Freestyle"),
    ("50 M Backstroke", 50, "Backstroke"),
    ("100 M Backstroke", 100, "Backstroke"),
    ("200 M Backstroke", 200, "Backstroke"),
    ("50 M Breaststroke", 50, "Breaststroke"),
    ("100 M Breaststroke", 100, "Breaststroke"),
    ("200 M Breaststroke", 200, "Breaststroke"),
    ("50 M Butterfly", 50, "Butterfly"),
    ("100 M Butterfly", 100, "Butterfly"),
    ("200 M Butterfly", 200, "Butterfly"),
    ("100 M Individual Medley", 100, "Individual Medley"),
    ("200 M Individual Medley", 200, "Individual Medley"),
    ("400 M Individual Medley", 400, "Individual Medley"),
    ("4x50 M Freestyle Relay", 200, "Freestyle Relay"),
    ("4x100 M Freestyle Relay", 400, "Freestyle Relay"),
    ("4x200 M Freestyle Relay", 800, "Freestyle Relay"),
    ("4x50 M Medley Relay", 200, "Medley Relay"),
    ("4x100 M Medley Relay", 400, "Medley Relay"),
]

# World Aquatics base times in seconds, by pool, event and (men, women, mixed).
BASE_TIMES = {
    "SCM": {
        "50 M Freestyle": (19.90, 22.83, None),
        "100 M Freestyle": (44.84, 50.25, None),
        "200 M Freestyle": (98.61, 110.31, None),
        "400 M Freestyle": (212.25, 230.25, None),
        "800 M Freestyle": (440.46, 477.42, None),
        "1500 M Freestyle": (846.88, 908.24, None),
        "50 M Backstroke": (22.11, 25.23, None),
        "100 M Backstroke": (48.33, 54.02, None),
        "200 M Backstroke": (105.63, 118.04, None),
        "50 M Breaststroke": (24.95, 28.37, None),
        "100 M Breaststroke": (55.28, 62.36, None),
        "200 M Breaststroke": (120.16, 132.50, None),
        "50 M Butterfly": (21.32, 23.94, None),
        "100 M Butterfly": (47.71, 52.71, None),
        "200 M Butterfly": (106.85, 119.32, None),
        "100 M Individual Medley": (49.28, 55.11, None),
        "200 M Individual Medley": (108.88, 121.63, None),
        "400 M Individual Medley": (234.81, 255.48, None),
        "4x50 M Freestyle Relay": (81.80, 92.50, 87.33),
        "4x100 M Freestyle Relay": (181.66, 205.01, None),
        "4x200 M Freestyle Relay": (400.51, 450.13, None),
        "4x50 M Medley Relay": (89.72, 102.35, 95.15),
        "4x100 M Medley Relay": (198.68, 220.41, None),
    },
    "LCM": {
        "50 M Freestyle": (20.91, 23.61, None),
        "100 M Freestyle": (46.40, 51.71, None),
        "200 M Freestyle": (102.00, 112.23, None),
        "400 M Freestyle": (219.96, 234.18, None),
        "800 M Freestyle": (452.12, 484.12, None),
        "1500 M Freestyle": (870.67, 920.48, None),
        "50 M Backstroke": (23.55, 26.86, None),
        "100 M Backstroke": (51.60, 57.13, None),
        "200 M Backstroke": (111.92, 123.14, None),
        "50 M Breaststroke": (25.95, 29.16, None),
        "100 M Breaststroke": (56.88, 64.13, None),
        "200 M Breaststroke": (125.48, 137.55, None),
        "50 M Butterfly": (22.27, 24.43, None),
        "100 M Butterfly": (49.45, 54.60, None),
        "200 M Butterfly": (110.34, 121.81, None),
        "200 M Individual Medley": (112.69, 125.70, None),
        "400 M Individual Medley": (242.50, 263.65, None),
        "4x100 M Freestyle Relay": (188.24, 207.96, 198.48),
        "4x200 M Freestyle Relay": (418.55, 457.50, None),
        "4x100 M Medley Relay": (206.78, 229.34, 217.43),
    },
}

# Lowest points and name of each tier; points over 1200 or under 100 are in none.
TIERS = [
    (1000, "World-Class"),
    (900, "International Elite"),
    (800, "Elite"),
    (700, "High Performance"),
    (600, "Advanced"),
    (500, "Competitive"),
    (400, "Developing"),
    (300, "Foundation"),
    (200, "Novice"),
    (100, "Entry Level"),
]
MOST_POINTS = 1200

#: U-age groups of records; None: open.
BANDS = [*range(10, 19), None]


def base_seconds(event: str, sex: str, pool: str) -> float | None:
    """The pool's base time, or the other pool's; mixed events without one take the men's."""
    for which in (sex, "M") if sex == "X" else (sex,):
        for table in (pool, "SCM" if pool == "LCM" else "LCM"):
            seconds = BASE_TIMES[table].get(event, (None, None, None))["MFX".index(which)]
            if seconds is not None:
                return seconds
    return None


def event_rows() -> list[tuple]:
    return [(i, name, distance, stroke, "Relay" in stroke, i) for i, (name, distance, stroke) in enumerate(EVENTS, 1)]


def events(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(event_rows(), "event_id int, event string, distance int, stroke string, is_relay boolean, sort_order int")


def base_rows() -> list[tuple]:
    return [(i, sex, pool, s) for i, (name, _, _) in enumerate(EVENTS, 1) for sex in "MFX" for pool in BASE_TIMES if (s := base_seconds(name, sex, pool)) is not None]


def base_times(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(base_rows(), "event_id int, sex string, pool string, base double")
