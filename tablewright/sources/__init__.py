"""Sources: files by extension, workbooks, JDBC tables, typed ingest, the registry."""
