"""Channel similarity on Spark: text preparation, channel vectors, top-k search, communities."""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
