"""Alert reconciliation, landing-table quality, grading and progress as Spark jobs."""
