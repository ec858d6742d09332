"""Cohort analytics on Spark: select a study population from event tables,
build one feature row per stay, describe it and validate outcome models."""
