"""Named query plans over the test tables (registry + DuckDB oracle twins)."""
