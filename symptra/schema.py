"""Study constants, ordered categories and table schemas."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import types as T

# Study window (half open), categories and labels of the survey.
STUDY_START = dt.date(2023, 11, 14)
STUDY_END = dt.date(2024, 3, 7)
EXCLUDED_REGION = "Scotland"

AGE_GROUPS = [
    "3 to 17 years",
    "18 to 34 years",
    "35 to 44 years",
    "45 to 54 years",
    "55 to 64 years",
    "65 to 74 years",
    "75 years and over",
]
ALL_AGES = "All"
AGE_GROUPS_WITH_ALL = [ALL_AGES, *AGE_GROUPS]

REGIONS = [
    "North East",
    "North West",
    "Yorkshire and The Humber",
    "East Midlands",
    "West Midlands",
    "East of England",
    "London",
    "South East",
    "South West",
]

MODELLED_SYMPTOMS = ["cough", "fever", "sore_throat", "short_breath", "loss_smell"]
ILI_SYMPTOMS = [
    "fever",
    "tiredness",
    "headache",
    "muscle_ache",
    "cough",
    "sore_throat",
    "short_breath",
    "loss_smell",
]
SYMPTOM_LABELS = {
    "cough": "Cough",
    "fever": "Fever",
    "sore_throat": "Sore throat",
    "short_breath": "Shortness of breath",
    "loss_smell": "Loss of smell",
}

SEARCH_TERMS = [
    "fever",
    "headache",
    "fatigue",
    "cough",
    "sore_throat",
    "shortness_of_breath",
    "common_cold",
    "myalgia",
    "anosmia",
]
SEARCH_TO_SURVEY = {"shortness_of_breath": "short_breath", "anosmia": "loss_smell"}
SEARCH_TAG = "Google trends"
BACKSHIFT_TAG = "Fixed back-shift"
DECONVOLUTION_TAG = "Deconvolution"
FIGURE_ORDER = [SEARCH_TAG, *AGE_GROUPS_WITH_ALL]
BANK_HOLIDAYS = [dt.date(2023, 12, 25), dt.date(2023, 12, 26)]

WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
MAX_WAVES = 4
MAX_DURATION_DAYS = 60
WINDOW_EXTENSION = 3
WINDOW_EXTENSIONS = [0, 3, 7, 10]
DISTRIBUTION_DAYS = 60

# Reported quantiles, column suffix -> probability.
BANDS = {"50": 0.5, "95": 0.95, "5": 0.05, "75": 0.75, "25": 0.25}
BANDS_90 = {"50": 0.5, "95": 0.95, "5": 0.05}

SURVEY_COLUMNS = [
    "submitted_at",
    "participant_id",
    "sex",
    "age",
    "rgn21nm",
    "imd_dec",
    "receive_date",
]
SURVEY_PREFIXES = ("window", "symptoms")

_FLAG_ORDER = ["cough", "fever", "sore_throat", "short_breath", "loss_smell", "tiredness", "headache", "muscle_ache"]

SUBMISSIONS = T.StructType(
    [
        T.StructField("submission_id", T.LongType()),
        T.StructField("participant_id", T.LongType()),
        T.StructField("submitted_at", T.DateType()),
        T.StructField("window_start_date", T.DateType()),
        T.StructField("symptoms_onset", T.DateType()),
        T.StructField("sex", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("rgn21nm", T.StringType()),
        T.StructField("imd_dec", T.IntegerType()),
        *[T.StructField(f"symptoms_new_{s}", T.BooleanType()) for s in _FLAG_ORDER],
        *[T.StructField(f"symptoms_{s}", T.BooleanType()) for s in _FLAG_ORDER],
    ]
)
POPULATION = T.StructType(
    [
        T.StructField("age", T.IntegerType()),
        T.StructField("region_name", T.StringType()),
        T.StructField("population", T.LongType()),
    ]
)
SEARCH_TRENDS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("symptom", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)
