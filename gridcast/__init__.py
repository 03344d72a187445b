"""gridcast: preparing, checking and scoring large collections of time series on Spark."""
