"""One query per operator, each over whole tables, with the SQL that states its result."""
