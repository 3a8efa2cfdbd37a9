"""eventcal: event-record harmonisation and calendar analytics on Spark DataFrames."""

__version__ = "0.1.0"
