"""Ways to obtain the catalog's relations: Parquet tables, Markdown trees, project files."""
