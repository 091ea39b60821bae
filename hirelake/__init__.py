"""Job-postings ELT on Spark: raw CSV tables, cleaned tables and a star schema."""
