"""lexshelf: indexing and reading large compressed XML page dumps with Spark."""
