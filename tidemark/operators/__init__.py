"""DataFrame operators: functions from DataFrames to DataFrames, without state or actions."""
