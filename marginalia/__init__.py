"""Document curation as Spark jobs: incremental intake, scoring, tagging, upserts."""
