"""cohortspark: registry records to person/event tables, cohorts, counts and odds ratios on Spark."""
