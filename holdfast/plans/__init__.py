"""Ready-made jobs: the daily run and the catalogue of reports with their SQL twins."""
