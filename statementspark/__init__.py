"""Bank-statement jobs on Spark: ingest, prove, resolve merchants, categorise and roll up, for many accounts at once."""
