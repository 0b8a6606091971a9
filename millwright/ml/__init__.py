"""The model pipeline: preparation, search, thresholds, cost, attribution, storage."""
