"""Market-data analytics on Spark: bars, indicators, signals, simulation, metrics."""
