"""chunkcast: divide-and-combine forecasting of long time series on Spark DataFrames."""

from chunkcast.config import ForecastConfig, SearchOptions

__all__ = ["ForecastConfig", "SearchOptions"]
