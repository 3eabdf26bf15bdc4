"""Small helpers on column names and expressions."""
