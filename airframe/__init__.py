"""Environmental series, guarded question answering and telemetry on Spark DataFrames."""

__version__ = "0.1.0"
