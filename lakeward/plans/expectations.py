"""Declared expectations on the source tables and staging models."""

from __future__ import annotations

import datetime as dt

from lakeward.operators.quality import Check

_YES_NO = ("Yes", "No")
_LEVELS = ("High", "Low", "Normal")

# What each source column may hold.
REV = [
    Check("not_null", ("disease",)),
    *[
        Check("accepted_values", (symptom,), _YES_NO)
        for symptom in ("fever", "cough", "fatigue", "difficulty_breathing")
    ],
    Check("not_null", ("age",)),
    Check("accepted_range", ("age",), (0, 120)),
    Check("not_null", ("gender",)),
    Check("accepted_values", ("gender",), ("Male", "Female")),
    Check("accepted_values", ("blood_pressure",), _LEVELS),
    Check("accepted_values", ("cholesterol_level",), _LEVELS),
    Check("not_null", ("outcome_variable",)),
    Check("accepted_values", ("outcome_variable",), ("Positive", "Negative")),
    Check("unique", ("disease", "age", "gender")),
]
PATIENT_DATA = [
    Check("not_null", ("patient_id",)),
    Check("unique", ("patient_id",)),
    Check("not_null", ("recorded_at",)),
]
DISEASE_TRENDS = [Check("not_null", ("trend_date",))]
STG_REV = [Check("not_null", ("outcome_binary",))]

# Age of the newest row that warns, and that fails.
REV_FRESHNESS = (dt.timedelta(hours=6), dt.timedelta(hours=24))
PATIENT_FRESHNESS = (dt.timedelta(days=1), dt.timedelta(days=3))
