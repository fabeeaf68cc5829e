"""tidegrid: hourly market time series on Spark DataFrames.

Every operator takes and returns lazy DataFrames keyed by ``(zone, ts_utc)``.
``ts_utc`` is TIMESTAMP_NTZ holding UTC wall-clock time, so no result depends
on the session time zone.
"""
