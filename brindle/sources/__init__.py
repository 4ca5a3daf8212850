"""Sources and the catalog of named relations."""
