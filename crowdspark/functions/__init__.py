from .dates import (SLOT_MICROS, TOLERANCE_MICROS, date_days, day_of_week_flags, day_text, hhmm,
                    micros, month_flags, monday_weekday, parse_day, parse_reading_time, time_metrics, unparsed_times,
                    slot_floor_micros, timestamp_from_micros, wall_clock_hhmm, wall_clock_text,
                    year_month)
from .numbers import (clip, closed_flag, exact_mean, falsy_zero, leading_int, nan_to_null, round_half_even_int,
                      round_to)
from .strings import CROWD_BANDS, crowd_label, last_path_part, park_label, same_text_ci

__all__ = [
    "SLOT_MICROS", "TOLERANCE_MICROS", "date_days", "day_of_week_flags", "day_text", "hhmm",
    "micros", "month_flags", "monday_weekday", "parse_day", "parse_reading_time", "time_metrics", "unparsed_times",
    "slot_floor_micros", "timestamp_from_micros", "wall_clock_hhmm", "wall_clock_text",
    "year_month", "clip", "closed_flag", "falsy_zero", "leading_int", "nan_to_null",
    "round_half_even_int", "round_to", "exact_mean", "CROWD_BANDS", "crowd_label", "last_path_part", "park_label",
    "same_text_ci",
]
