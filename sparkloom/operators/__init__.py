"""DataFrame operators: functions of DataFrames, lazily planned."""
