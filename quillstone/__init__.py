"""quillstone: data preparation, time-series and statistics operators on Spark DataFrames."""

__version__ = "0.1.0"
