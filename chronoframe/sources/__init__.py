"""Where interval relations come from: text files, Parquet, views of tables, seeded generators."""
