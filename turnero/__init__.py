"""Appointment scheduling analytics on Spark.

Every function takes and returns plain DataFrames.  Nothing here owns a session or fixes a physical
strategy: joins, aggregations and windows are declared and Catalyst and AQE choose how to run them.
What comes to the driver is bounded: months of a table, commit rows, counters per task or bucket.
"""
