"""The library's operators applied to the given tables, each with the SQL that states the same rows."""
