"""Fixed schemas of the stored and landed tables."""

from pyspark.sql import types as T

# Stored readings as ingest writes them: one row per ride and 15-minute slot, partitioned by day.
QUEUE_DATA = T.StructType([
    T.StructField("ride_id", T.StringType()),
    T.StructField("slot", T.TimestampType()),
    T.StructField("time_of_day", T.StringType()),
    T.StructField("queue_time", T.IntegerType()),
    T.StructField("is_closed", T.IntegerType()),
    T.StructField("date", T.DateType()),
])

# Ride dimension, key (ride_id, park_id).
PARK_INFO = T.StructType([
    T.StructField("ride_id", T.StringType()),
    T.StructField("park_id", T.StringType()),
    T.StructField("ride_name", T.StringType()),
])

DATASET = T.StructType([
    T.StructField("label", T.StringType()),
    T.StructField("data", T.ArrayType(T.IntegerType())),
])

PANEL = T.StructType([
    T.StructField("href", T.StringType()),
    T.StructField("ride_name", T.StringType()),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("datasets", T.ArrayType(DATASET)),
])

# Captured chart payload: one row per park and calendar page.
CHART_PAYLOAD = T.StructType([
    T.StructField("park_id", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("panels", T.ArrayType(PANEL)),
])

DIRECTORY_PARK = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("latitude", T.StringType()),
    T.StructField("longitude", T.StringType()),
])

# Park directory document: companies, each with a list of parks.
PARK_DIRECTORY = T.StructType([
    T.StructField("companies", T.ArrayType(T.StructType([
        T.StructField("company", T.StringType()),
        T.StructField("parks", T.ArrayType(DIRECTORY_PARK)),
    ]))),
])

DESTINATION_DIRECTORY = T.StructType([
    T.StructField("destinations", T.ArrayType(T.StructType([
        T.StructField("destination", T.StringType()),
        T.StructField("parks", T.ArrayType(T.StructType([
            T.StructField("id", T.StringType()),
            T.StructField("name", T.StringType()),
        ]))),
    ]))),
])

PUBLIC_HOLIDAY = T.StructType([
    T.StructField("country_code", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("name", T.StringType()),
])

SCHOOL_PERIOD = T.StructType([
    T.StructField("country", T.StringType()),
    T.StructField("holiday_name", T.StringType()),
    T.StructField("start_date", T.StringType()),
    T.StructField("end_date", T.StringType()),
])

SCHEDULE_ENTRY = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("openingTime", T.StringType()),
    T.StructField("closingTime", T.StringType()),
])

SCHEDULE_PAYLOAD = T.StructType([
    T.StructField("park_id", T.StringType()),
    T.StructField("year_month", T.StringType()),
    T.StructField("schedule", T.ArrayType(SCHEDULE_ENTRY)),
])

DAILY_WEATHER = T.StructType([
    T.StructField("park_id", T.StringType()),
    T.StructField("date", T.DateType()),
    T.StructField("tavg", T.DoubleType()),
    T.StructField("prcp", T.DoubleType()),
    T.StructField("wspd", T.DoubleType()),
])

FORECAST_PAYLOAD = T.StructType([
    T.StructField("park_id", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("daily", T.StructType([
        T.StructField("time", T.ArrayType(T.StringType())),
        T.StructField("temperature_2m_mean", T.ArrayType(T.DoubleType())),
        T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
        T.StructField("windspeed_10m_mean", T.ArrayType(T.DoubleType())),
    ])),
])

# Feature columns produced by the preparation steps (park one-hots are appended per data).
DAY_OF_WEEK_COLS = [f"day_of_week_{i}" for i in range(1, 8)]
MONTH_COLS = [f"month_{i}" for i in range(1, 13)]
OPENING_COLS = ["opening_hr", "closing_hr", "hours_open_for"]
WEATHER_COLS = ["temperature_c", "precipitation_mm", "wind_speed_kmh"]
FEATURE_COLS = DAY_OF_WEEK_COLS + MONTH_COLS + ["is_bank_holiday", "is_school_holiday"] + OPENING_COLS + WEATHER_COLS
