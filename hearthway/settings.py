"""Default parameters of the analysis. All of them can be passed explicitly."""

# They decide the results, so they are stated as they are.

SERVICES = [
    "doctor",
    "dentist",
    "pharmacy",
    "kindergarten_nursery",
    "school",
    "supermarket",
    "library",
    "train_station",
    "sports_facility",
]

SERVICE_WEIGHTS = {
    "doctor": 0.05,
    "dentist": 0.05,
    "pharmacy": 0.05,
    "kindergarten_nursery": 5,
    "school": 5,
    "supermarket": 5,
    "library": 1,
    "train_station": 5,
    "sports_facility": 1,
}

SERVICE_CODES = {
    "doctor": [862100],
    "dentist": [862300],
    "pharmacy": [477300],
    "kindergarten_nursery": [889130, 889120],
    "school": [852010],
    "supermarket": [471120, 471130],
    "library": [911100],
    "train_station": [49],
    "sports_facility": [93],
}

TRIP_FILE_SUFFIX = "_otp_geo.parquet"
TRIP_MEASURES = [
    "duration_min",
    "wait_time_dest_min",
    "total_time_min",
    "walkDistance",
    "abs_dist",
    "transfers",
]
TIME_COLUMNS = ["duration_min", "wait_time_dest_min", "total_time_min"]
ANALYSIS_TOKENS = [
    "duration_min",
    "wait_time_dest_min",
    "total_time_min",
    "abs_dist",
    "no_connection_count",
]
SUMMARY_MEASURES = [
    "mean_duration",
    "max_duration",
    "median_duration",
    "mean_wait_time",
    "max_wait_time",
    "median_wait_time",
    "median_transfers",
    "max_transfers",
]

WEIGHTED_TIME_BOUNDS = [1000, 2000, 3000, 4000, 5000]
TOTAL_TIME_BOUNDS = [200, 400, 600, 800, 1000, 1200, 1400, 1600]
BIVARIATE_BOUNDS = [0.25, 0.5, 0.75, 1]

FALLBACK_METRES = 300
GRID_BUFFER_METRES = 300
KNN_NEIGHBOURS = 6
CLUSTERS = 6
CLUSTER_SEEDS = [13, 27, 42, 99]
SIGNIFICANCE = 0.05
PERMUTATIONS = 999
LOCAL_TIME_ZONE = "Europe/Copenhagen"

AGE_BANDS = [
    "18-19",
    "20-24",
    "25-29",
    "30-34",
    "35-39",
    "40-44",
    "45-49",
    "50-54",
    "55-59",
    "60-64",
    "65-69",
    "70-",
]
AGE_MERGES = {
    "18-29": ["18-19", "20-24", "25-29"],
    "30-39": ["30-34", "35-39"],
    "40-49": ["40-44", "45-49"],
    "50-59": ["50-54", "55-59"],
    "60-69": ["60-64", "65-69"],
}
AGE_GROUPS = ["-17", "18-29", "30-39", "40-49", "50-59", "60-69", "70-"]

CENSUS_POPULATION = "EV2024 - Personer efter forsørgelsestype_12. Antal personer i alt"
CENSUS_NAMES = {
    "EV2024 - Husstande efter bilrådighed_2. Husstande med 1 bil": "households_with_1_car",
    "EV2024 - Husstande efter bilrådighed_3. Husstande med 2 eller flere biler": "households_with_2_cars",
    "EV2024 - Husstande efter bilrådighed_1. Husstande uden bil": "households_without_car",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_Under 100.000 kr.": "households_income_under_100k",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_100.000 - 149.999 kr": "households_income_100k_150k",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_150.000 - 199.999 kr.": "households_income_150k_200k",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_200.000 - 299.999 kr.": "households_income_200k_300k",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_300.000 - 399.999 kr.": "households_income_300k_400k",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_400.000 - 499.999 kr.": "households_income_400k_500k",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_500.000 - 749.999 kr.": "households_income_500k_750k",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_750.000 kr.-": "households_income_750k_",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_50%-percentil for husstandsindkomst": "households_income_50_percentile",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_80%-percentil for husstandsindkomst": "households_income_80_percentile",
    "EV2024 - Husstandsindkomster fordelt på afstemningsområder_Antal husstande i alt": "households",
    CENSUS_POPULATION: "population",
    "EV2024 - Socio-økonomisk status og brancher fordelt på afstemningsområder_08. Uddannelsessøgende_12. Uoplyst aktivitet": "students",
}
INCOME_SHARES = {
    "households_income_under_100k_pct": "households_income_under_100k",
    "households_income_100_150k_pct": "households_income_100k_150k",
    "households_income_150_200k_pct": "households_income_150k_200k",
    "households_income_200_300k_pct": "households_income_200k_300k",
    "households_income_300_400k_pct": "households_income_300k_400k",
    "households_income_400_500k_pct": "households_income_400k_500k",
    "households_income_500_750k_pct": "households_income_500k_750k",
    "households_income_750k_pct": "households_income_750k_",
}
CAR_SHARES = {
    "households_1car_pct": "households_with_1_car",
    "households_2cars_pct": "households_with_2_cars",
    "households_nocar_pct": "households_without_car",
}
INCOME_GROUPS = {
    "households_income_under_150k_pct": [
        "households_income_under_100k_pct",
        "households_income_100_150k_pct",
    ],
    "low_income_pct": [
        "households_income_under_150k_pct",
        "households_income_150_200k_pct",
        "households_income_200_300k_pct",
    ],
    "medium_income_pct": [
        "households_income_300_400k_pct",
        "households_income_400_500k_pct",
    ],
    "high_income_pct": [
        "households_income_500_750k_pct",
        "households_income_750k_pct",
    ],
}
