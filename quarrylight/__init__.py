"""Document analytics on Spark: text cleaning, search, evidence checks, claim scoring, versions, exports."""
