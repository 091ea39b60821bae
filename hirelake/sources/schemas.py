"""Column types of the raw tables; columns not listed stay text."""

RAW_SCHEMAS = {
    "jobs": """
        job_id bigint, company_id double, title string, max_salary double, min_salary double,
        med_salary double, pay_period string, formatted_work_type string, location string,
        remote_allowed double, views double, applies double, formatted_experience_level string,
        listed_time double, expiry double, closed_time double, original_listed_time double,
        skills_desc string, posting_domain string, application_url string, job_posting_url string,
        work_type string, currency string, compensation_type string, normalized_salary double,
        zip_code double, fips double
    """,
    "companies": """
        company_id bigint, name string, description string, company_size double, state string,
        country string, city string, zip_code string, address string
    """,
    "employee_counts": "company_id bigint, employee_count bigint, follower_count bigint, time_recorded bigint",
    "industries": "company_id bigint, industry string",
    "benefits": "job_id bigint, inferred bigint, type string",
    "salaries": """
        job_id bigint, max_salary double, med_salary double, min_salary double,
        pay_period string, currency string
    """,
    "skills_industries": "skill_abr string, skill_name string",
}
