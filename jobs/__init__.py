"""Jobs that run on their own: python -m jobs.NAME --help."""
