"""Fixed values that results depend on: code sets, bands, maps, release ranges.

Everything here is data, kept in its natural order; operators take these as
defaults and accept other values.
"""

# Usual principal status codes that count as employed.
EMPLOYED_STATUS = [11, 12, 21, 31, 41, 51]

# Social-security benefit codes: eligible for some benefit, for none.
BENEFIT_CODES_TRUE = [1, 2, 3, 4, 5, 6, 7]
BENEFIT_CODES_FALSE = [8]

# Raw survey column to working column.
SURVEY_COLUMNS = {
    "b1q3_perv1": "sector_code",
    "state_perv1": "state",
    "b4q5_perv1": "sex_code",
    "b4q6_perv1": "age",
    "b4q8_perv1": "edu_code",
    "b5pt1q3_perv1": "status_code",
    "b5pt1q5_perv1": "nic5",
    "b5pt1q6_perv1": "nco3_raw",
    "b5pt1q13_perv1": "ss_benefit_code",
    "b6q9_perv1": "earnings_regular",
    "b6q10_perv1": "earnings_self",
    "mult_perv1": "mult",
    "no_qtr_perv1": "no_qtr",
    "NSS_perv1": "nss",
    "NSC_perv1": "nsc",
}

# Entry-rung age bands (inclusive) and the white-collar divisions.
AGE_BANDS = [
    (15, 19), (20, 24), (25, 29), (30, 34), (35, 39),
    (40, 44), (45, 49), (50, 54), (55, 59), (60, 64),
]
WHITE_COLLAR = ["1", "2", "3", "4"]
HIGH_SCORE = 0.5

# Score histogram bins, lower bound included, upper excluded.
SCORE_BINS = [
    ("0-.05", 0.0, 0.05),
    (".05-.10", 0.05, 0.1),
    (".10-.20", 0.1, 0.2),
    (".20-.30", 0.2, 0.3),
    (".30-.40", 0.3, 0.4),
    (".40-.50", 0.4, 0.5),
    (".50+", 0.5, 1.01),
]

# Education labels and their code sets.
EDUCATION = [
    ("Not literate", [1]),
    ("Below primary", [2, 3, 4, 5]),
    ("Primary", [6]),
    ("Middle", [7]),
    ("Secondary", [8]),
    ("Higher secondary", [10]),
    ("Diploma", [11]),
    ("Graduate", [12]),
    ("Postgraduate+", [13]),
]
POST_SECONDARY = [10, 11, 12, 13]

# Three sectors as half-open ranges of industry divisions.
SECTORS = [("agriculture", 1, 4), ("industry", 5, 44), ("services", 45, 100)]

# Industry sections as half-open ranges of industry divisions.
SECTIONS = [
    ("Agriculture", 1, 4),
    ("Mining", 5, 10),
    ("Manufacturing", 10, 34),
    ("Utilities", 35, 40),
    ("Construction", 41, 44),
    ("Trade & retail", 45, 48),
    ("Transport & logistics", 49, 54),
    ("Hotels & food", 55, 57),
    ("IT & communication", 58, 64),
    ("Finance & insurance", 64, 67),
    ("Real estate", 68, 69),
    ("Professional services", 69, 76),
    ("Admin & support svcs", 77, 83),
    ("Public administration", 84, 85),
    ("Education", 85, 86),
    ("Health & social work", 86, 89),
    ("Other services", 90, 100),
]

# Value added by activity and the half-open division ranges of each.
ACTIVITIES = [
    ("Agriculture & allied", 4877867, [(1, 4)]),
    ("Mining & quarrying", 532343, [(5, 10)]),
    ("Manufacturing", 3921596, [(10, 34)]),
    ("Utilities", 766435, [(35, 40)]),
    ("Construction", 2401618, [(41, 44)]),
    ("Trade, hotels, transport, comms", 4828505, [(45, 48), (49, 54), (55, 57), (58, 62)]),
    ("Financial, real estate, prof. svcs", 6244153, [(62, 64), (64, 69), (69, 76), (77, 83)]),
    ("Public admin, defence, other svcs", 3840370, [(84, 86), (86, 89), (90, 100)]),
]
ACTIVITY_TOTAL = 27412888

# Industry head to its two-digit divisions, in the order of the source list.
HEAD_DIVISIONS = [
    ("EXPERT SERVICES", ["69", "70", "71", "73", "74", "78", "80", "82"]),
    (
        "ESTABLISHMENT ENGAGED IN MANUFACTURE, MARKETING SERVICING, USAGE OF COMPUTERS",
        ["26", "62", "63"],
    ),
    ("TRADING - COMMERCIAL ESTABLISHMENTS", ["45", "46", "47"]),
    ("BUILDING AND CONSTRUCTION INDUSTRY", ["41", "42", "43"]),
    ("ENGINEERS - ENGG. CONTRACTORS", ["33", "42", "71"]),
    ("ELEC, MECH OR GEN ENGG PRODUCTS", ["25", "27", "28"]),
    ("ESTABLISHMENTS ENGAGED IN CLEANING,SWEEPING SERVICES", ["81"]),
    ("TEXTILES", ["13"]),
    ("GARMENTS MAKING", ["14"]),
    ("FINANCING ESTABLISHMENT", ["64", "66"]),
    ("GENERAL INSURANCE", ["65"]),
    ("SCHOOL", ["85"]),
    ("HOSPITALS", ["86"]),
    ("SOCIETIES CLUBS OR ASSOCIATIONS", ["94"]),
    ("HOTEL", ["55", "56"]),
    ("PLASTICS PRODUCTS", ["22"]),
    ("OTHERS", []),
]

# Payroll panel vocabulary.
PAYROLL_BANDS = ["<18", "18-21", "22-25", "26-28", "29-35", ">35"]
BAND_ALIASES = {
    "less than 18": "<18",
    "<18": "<18",
    "18-21": "18-21",
    "22-25": "22-25",
    "26-28": "26-28",
    "29-35": "29-35",
    "more than 35": ">35",
    ">35": ">35",
}
GENDER_ALIASES = {
    "male": "male",
    "female": "female",
    "transgender": "transgender",
    "others": "transgender",
    "notavailable": "not_available",
    "total": "total",
}
GENDERS = ["male", "female", "transgender", "not_available"]
FLOW_MEASURES = ["new_subscribers", "ceased", "rejoined", "net_payroll"]
GROSS_MEASURES = ["new_subscribers", "ceased", "rejoined"]
MONTH_NAMES = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]
MONTH_TYPOS = {"sepember": 9}
MONTH_RANGE = ("2017-09", "2026-12")
HEADER_FIXES = {("epfo_2021-05", "Apr-19"): "2020-04"}
INDUSTRY_FIXES = {
    "ESTABLISHMENT ENGAGED IN MANUFACTURE, MARKETING SERVICING, USAGE OF COMP":
        "ESTABLISHMENT ENGAGED IN MANUFACTURE, MARKETING SERVICING, USAGE OF COMPUTERS",
}
GENDER_COLUMNS_16 = list(range(1, 16))
GENDER_COLUMNS_18 = [1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 13, 14, 15, 16, 17]

# Release and the months it owns.
RELEASES = [
    ("epfo_2021-05", "2020-04", "2021-03"),
    ("epfo_2022-05", "2021-04", "2022-03"),
    ("epfo_2023-05", "2022-04", "2023-03"),
    ("epfo_2024-02", "2023-04", "2023-12"),
    ("epfo_2024-03", "2024-01", "2024-01"),
    ("epfo_2024-04", "2024-02", "2024-02"),
    ("epfo_2024-05", "2024-03", "2024-03"),
    ("epfo_2025-05", "2024-04", "2025-03"),
    ("epfo_2025-09", "2025-04", "2025-07"),
    ("mospi_2019-03", "2017-09", "2019-01"),
    ("mospi_2019-12", "2019-04", "2019-10"),
]
SERIES_BREAK_BEFORE = "2020-04"
PROVISIONAL_FROM = "2025-03"

# Event-study settings.
YOUNG_BANDS = ["18-21", "22-25"]
OLDER_BANDS = ["29-35", ">35"]
POST_START = "2022-11"
REFERENCE_QUARTER = "2022Q4"
REBOUND_WINDOW = ("2020-04", "2021-03")

# Limits at which a run stops.
MIN_KAPPA = 0.7
MIN_COVERAGE = 0.90
MAX_FAILURE_RATE = 0.02
BUDGET = 200.0

# Note tags counted on rating sheets.
NOTE_TAGS = ["R-03", "R-04", "R-05"]
SAMPLE_PER_LABEL = 200
SEED = 42
