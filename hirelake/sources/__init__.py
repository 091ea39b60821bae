"""Reading CSV, and reading and writing the layers."""
