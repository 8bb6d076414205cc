"""Default column set, labels and limits for clinical heart-risk tables.

Operators never read this module; callers pass what they need from it.
"""

from __future__ import annotations

from dataclasses import dataclass

# Column order of the headerless table, names shown to readers, descriptions,
# code labels, form limits and risk messages.

LABEL = "target"

RAW_COLUMNS = [
    "age", "sex", "cp", "trestbps", "chol", "fbs", "restecg",
    "thalach", "exang", "oldpeak", "slope", "ca", "thal", "target",
]

CORE_FEATURES = [
    "age", "sex", "cp", "trestbps", "chol", "fbs", "restecg",
    "thalach", "exang", "oldpeak", "slope",
]

SPARSE_CANDIDATES = ["ca", "thal"]

CODE_COLUMNS = ["sex", "cp", "fbs", "restecg", "exang", "slope"]

DISPLAY_NAMES = {
    "age": "Age",
    "sex": "Sex",
    "cp": "Chest Pain Type",
    "trestbps": "Resting Blood Pressure",
    "chol": "Cholesterol",
    "fbs": "Fasting Blood Sugar",
    "restecg": "Resting ECG",
    "thalach": "Max Heart Rate",
    "exang": "Exercise Angina",
    "oldpeak": "ST Depression (Oldpeak)",
    "slope": "ST Slope",
    "ca": "Major Vessels (CA)",
    "thal": "Thalassemia",
    "target": "Heart Disease",
}

DESCRIPTIONS = {
    "age": "Age of the patient in years",
    "sex": "Sex (1 = Male, 0 = Female)",
    "cp": "Chest pain type (0=Typical Angina, 1=Atypical, 2=Non-anginal, 3=Asymptomatic)",
    "trestbps": "Resting blood pressure in mm Hg",
    "chol": "Serum cholesterol in mg/dl",
    "fbs": "Fasting blood sugar > 120 mg/dl (1=True, 0=False)",
    "restecg": "Resting ECG results (0=Normal, 1=ST-T Abnormality, 2=LVH)",
    "thalach": "Maximum heart rate achieved",
    "exang": "Exercise-induced angina (1=Yes, 0=No)",
    "oldpeak": "ST depression induced by exercise relative to rest",
    "slope": "Slope of peak exercise ST segment (0=Up, 1=Flat, 2=Down)",
    "ca": "Number of major vessels colored by fluoroscopy (0–3)",
    "thal": "Thalassemia (1=Normal, 2=Fixed Defect, 3=Reversible Defect)",
}

REPORT_NAMES = {
    "age": "Age (years)",
    "sex": "Sex (1=Male, 0=Female)",
    "cp": "Chest Pain Type",
    "trestbps": "Resting BP (mm Hg)",
    "chol": "Cholesterol (mg/dl)",
    "fbs": "Fasting Blood Sugar > 120",
    "restecg": "Resting ECG",
    "thalach": "Max Heart Rate",
    "exang": "Exercise Angina",
    "oldpeak": "ST Depression (Oldpeak)",
    "slope": "ST Slope",
    "ca": "Major Vessels (CA)",
    "thal": "Thalassemia",
}

SUMMARY_NAMES = {
    "age": "Age",
    "sex": "Sex",
    "cp": "Chest Pain",
    "trestbps": "Resting BP",
    "chol": "Cholesterol",
    "fbs": "Fasting BS",
    "restecg": "ECG",
    "thalach": "Max HR",
    "exang": "Exercise Angina",
    "oldpeak": "ST Depression",
    "slope": "ST Slope",
    "ca": "Vessels (CA)",
    "thal": "Thalassemia",
}

CODE_LABELS = {
    "sex": {0: "Female", 1: "Male"},
    "cp": {0: "Typical Angina", 1: "Atypical Angina", 2: "Non-Anginal Pain", 3: "Asymptomatic"},
    "fbs": {0: "No", 1: "Yes"},
    "restecg": {0: "Normal", 1: "ST-T Abnormality", 2: "Left Ventricular Hypertrophy"},
    "exang": {0: "No", 1: "Yes"},
    "slope": {0: "Upsloping", 1: "Flat", 2: "Downsloping"},
    "target": {0: "Healthy", 1: "Disease"},
}


@dataclass(frozen=True)
class Domain:
    """Allowed values of one input: a range, or a list of codes."""

    low: float | None = None
    high: float | None = None
    step: float | None = None
    options: tuple[int, ...] | None = None
    default: float = 0.0


DOMAINS = {
    "age": Domain(20, 100, 1, default=50),
    "sex": Domain(options=(0, 1), default=1),
    "cp": Domain(options=(0, 1, 2, 3), default=0),
    "trestbps": Domain(80, 220, 1, default=120),
    "chol": Domain(100, 600, 1, default=200),
    "fbs": Domain(options=(0, 1), default=0),
    "restecg": Domain(options=(0, 1, 2), default=0),
    "thalach": Domain(60, 220, 1, default=150),
    "exang": Domain(options=(0, 1), default=0),
    "oldpeak": Domain(0.0, 10.0, 0.1, default=1.0),
    "slope": Domain(options=(0, 1, 2), default=1),
}

RISK_CUTS = (0.35, 0.65)
GAUGE_CUTS = (0.40, 0.65)
RISK_BANDS = ("Low", "Moderate", "High")
RISK_MESSAGES = {
    "Low": "Low probability of heart disease. Maintain a healthy lifestyle.",
    "Moderate": "Moderate risk detected. Consider a cardiology consultation.",
    "High": "High risk detected. Immediate medical evaluation is recommended.",
}

METRIC_NAMES = {
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1": "F1 Score",
    "roc_auc": "ROC-AUC",
}

MEDALS = {1: "\U0001F947", 2: "\U0001F948", 3: "\U0001F949"}
