"""Values that results depend on. All of them are fixed; none is derived."""

# --- Fixed values: tables and layers -------------------------------------------------
RAW_TABLES = (
    "jobs",
    "benefits",
    "salaries",
    "employee_counts",
    "industries",
    "companies",
    "skills_industries",
)
CLEANED_TABLES = ("jobs", "salaries", "benefits", "employee_counts", "industries", "companies")
MODEL_TABLES = ("dim_company", "dim_location", "dim_time", "fact_jobs")
RAW_INDEXES = {
    "jobs": ("job_id", "original_listed_time"),
    "salaries": ("job_id",),
    "benefits": ("job_id",),
    "employee_counts": ("company_id",),
    "industries": ("company_id",),
    "skills_industries": ("skill_abr",),
    "companies": ("company_id",),
}
LAYERS = ("raw", "cleaned", "dimensional_model")

# --- Fixed values: text that CSV ingest reads as null --------------------------------
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "n/a",
    "nan",
    "null",
)

# --- Fixed values: units of one foreign currency in USD ------------------------------
CLEANING_RATES = {"USD": 1.0, "EUR": 1.09, "GBP": 1.28, "CAD": 0.74, "AUD": 0.67, "BBD": 0.50}
MODEL_RATES = {"USD": 1.0, "EUR": 1.10, "GBP": 1.28, "CAD": 0.71, "AUD": 0.60, "BBD": 0.50}

# --- Fixed values: pay periods per year (2080 = 40 hours x 52 weeks) -----------------
PERIODS_PER_YEAR = {"YEARLY": 1.0, "MONTHLY": 12.0, "BIWEEKLY": 26.0, "WEEKLY": 52.0, "HOURLY": 2080.0}

# --- Fixed values: salary limits -----------------------------------------------------
IQR_FACTOR = 1.5
FACT_SALARY_CAP = 124000.0

# --- Fixed values: columns and defaults of the cleaning step -------------------------
JOB_COLUMNS_DROPPED = (
    "med_salary",
    "work_type",
    "applies",
    "closed_time",
    "skills_desc",
    "max_salary",
    "min_salary",
    "fips",
    "listed_time",
    "expiry",
    "compensation_type",
    "application_url",
    "posting_domain",
)
SALARY_COLUMNS = ("min_salary", "max_salary", "med_salary")
NOT_SPECIFIED = "No specified"
UNKNOWN = "Unknown"
COMPANY_DEFAULTS = {
    "zip_code": "Unknown",
    "state": "Unknown",
    "city": "Unknown",
    "description": "No description",
    "address": "No specific address",
}

# --- Fixed values: columns of the star schema ----------------------------------------
LOCATION_COLUMNS = ("city", "state", "zip_code", "country")
DIM_COMPANY_COLUMNS = (
    "company_id",
    "name",
    "company_size",
    "employee_count",
    "industry",
    "country",
    "city",
    "state",
    "zip_code",
)
FACT_JOB_COLUMNS = (
    "job_id",
    "company_id",
    "title",
    "views",
    "remote_allowed",
    "original_listed_time",
    "job_id_modify",
    "company_id_modify",
    "normalized_salary",
    "currency",
    "pay_period",
)
FACT_COLUMNS = (
    "job_id",
    "company_key",
    "location_key",
    "time_key",
    "title",
    "views",
    "remote_allowed",
    "benefits_count",
    "normalized_salary",
    "currency",
    "pay_period",
)

# --- Fixed values: years a nanosecond timestamp can hold, as whole milliseconds ------
MAX_EPOCH_MS = 9223372036854
MAX_EPOCH_S = 9223372036
