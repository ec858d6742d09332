"""Code lists, labels and plausibility caps.

Fixed values: item codes, labels, caps, text values and diagnosis prefixes
have to equal those of the source data sets for results to match.
"""

from __future__ import annotations

# Laboratory item -> (label, largest plausible value).
LAB_CODES: dict[int, tuple[str, float]] = {
    50868: ("aniongap", 10000),
    50862: ("albumin", 10),
    50882: ("bicarbonate", 10000),
    50885: ("bilirubin", 150),
    50912: ("creatinine", 150),
    50806: ("chloride", 10000),
    50902: ("chloride", 10000),
    50809: ("glucose", 10000),
    50931: ("glucose", 10000),
    50810: ("hematocrit", 100),
    51221: ("hematocrit", 100),
    50811: ("hemoglobin", 50),
    51222: ("hemoglobin", 50),
    50813: ("lactate", 50),
    50960: ("magnesium", 60),
    50970: ("phosphate", 60),
    51265: ("platelet", 10000),
    50822: ("potassium", 30),
    50971: ("potassium", 30),
    51275: ("ptt", 150),
    51237: ("inr", 50),
    51274: ("pt", 150),
    50824: ("sodium", 200),
    50983: ("sodium", 200),
    51006: ("bun", 300),
    51300: ("wbc", 1000),
    51301: ("wbc", 1000),
    50893: ("calcium", 300),
    50808: ("freecalcium", 500),
}

# Vital sign -> charted items.
VITAL_CODES: dict[str, tuple[int, ...]] = {
    "temperature": (223761, 678),
    "respiration": (220210, 618, 3603),
    "heart_rate": (220045, 211),
    "arterial_bp_systolic": (220179, 220050, 51, 3313),
    "arterial_bp_diastolic": (220180, 220051, 8502, 8368),
    "arterial_bp_mean": (220181, 220052, 52, 3312),
}

# Liver enzyme -> charted items.
LIVER_CODES: dict[str, tuple[int, ...]] = {
    "ast": (769, 220587),
    "alt": (770, 220644),
}

# Charted items of the older system that show renal
# replacement, with the texts that count (None: any text).
RRT_TEXT_RULES: tuple[tuple[tuple[int, ...], tuple[str, ...] | None], ...] = (
    ((152, 148, 149, 146, 147, 151, 150), None),
    ((229, 235, 241, 247, 253, 259, 265, 271), ("Dialysis Line",)),
    ((466,), ("Dialysis RN",)),
    ((927,), ("Dialysis Solutions",)),
    ((6250,), ("dialys",)),
    (
        (917,),
        (
            "+ INITIATE DIALYSIS",
            "BLEEDING FROM DIALYSIS CATHETER",
            "FAILED DIALYSIS CATH.",
            "FEBRILE SYNDROME;DIALYSIS",
            "HYPOTENSION WITH HEMODIALYSIS",
            "HYPOTENSION.GLOGGED DIALYSIS",
            "INFECTED DIALYSIS CATHETER",
        ),
    ),
    (
        (582,),
        ("CAVH Start", "CAVH D/C", "CVVHD Start", "CVVHD D/C", "Hemodialysis st", "Hemodialysis end"),
    ),
)

# Renal replacement items per source.
RRT_INTAKE_OLD = (
    40788, 40907, 41063, 41147, 41307, 41460, 41620, 41711, 41791, 41792,
    42562, 43829, 44037, 44188, 44526, 44527, 44584, 44591, 44698, 44927,
    44954, 45157, 45268, 45352, 45353, 46012, 46013, 46172, 46173, 46250,
    46262, 46292, 46293, 46311, 46389, 46574, 46681, 46720, 46769, 46773,
)
RRT_OUTPUT_OLD = (
    40386, 40425, 40426, 40507, 40613, 40624, 40690, 40745, 40789, 40881,
    40910, 41016, 41034, 41069, 41112, 41250, 41374, 41417, 41500, 41527,
    41623, 41635, 41713, 41750, 41829, 41842, 41897, 42289, 42388, 42464,
    42524, 42536, 42868, 42928, 42972, 43016, 43052, 43098, 43115, 43687,
    43941, 44027, 44085, 44193, 44199, 44216, 44286, 44567, 44843, 44845,
    44857, 44901, 44943, 45479, 45828, 46230, 46232, 46394, 46464, 46712,
    46713, 46715, 46741,
)
RRT_CHART_NEW = (
    226118, 227357, 225725,
    226499, 224154, 225810, 227639, 225183, 227438, 224191, 225806, 225807,
    228004, 228005, 228006, 224144, 224145, 224149, 224150, 224151, 224152,
    224153, 224404, 224406, 226457, 225959,
    224135, 224139, 224146, 225323, 225740, 225776, 225951, 225952, 225953,
    225954, 225956, 225958, 225961, 225963, 225965, 225976, 225977, 227124,
    227290, 227638, 227640, 227753,
)
RRT_INTAKE_NEW = (227536, 227525)
RRT_DATES_NEW = (225318, 225319, 225321, 225322, 225324)
RRT_PROCEDURES_NEW = (225441, 225802, 225803, 225805, 224270, 225809, 225955, 225436)

# Transfusion items per intake system (newer, older).
RED_CELLS = ((225168, 226368), (30001, 30104))
PLATELETS = ((225170, 226369), (30006,))

# Diagnosis type -> (three-character prefixes, whole codes).
MALIGNANCY_TYPES: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "lymphoma": (("200", "201", "202"), ()),
    "myeloma": (("203",), ()),
    "leukemia": (("204", "205", "206", "207", "208"), ()),
    "myelodysplastic_syndrome": ((), ("23872", "23873", "23874", "23875")),
}

# Comorbidities and first-day blood gas measures carried over.
COMORBIDITIES = (
    "hypertension", "congestive_heart_failure", "cardiac_arrhythmias", "chronic_pulmonary",
    "depression", "diabetes_uncomplicated", "hypothyroidism", "renal_failure",
    "rheumatoid_arthritis", "liver_disease", "peptic_ulcer",
)
BLOOD_GAS = ("ph", "pco2", "po2", "bicarbonate", "baseexcess", "spo2", "lactate")

# Linear unit conversions, new = (old + offset) * scale.
UNITS_TO_SI: dict[str, tuple[float, float]] = {
    "creatinine": (88.42, 0.0),
    "bilirubin": (17.1, 0.0),
    "urea": (0.3571, 0.0),
    "temperature": (1 / 1.8, -32.0),
}
