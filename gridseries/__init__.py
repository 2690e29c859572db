"""Regular-grid time series on Spark: audits, features, splits, forecasts and their errors, for many series at once."""
