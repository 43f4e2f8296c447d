"""A PySpark engine for job postings: sources, snapshots, deduplication, classification and reports."""
