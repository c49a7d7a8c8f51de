"""Named queries over the Parquet tables, with the SQL that each must equal."""
