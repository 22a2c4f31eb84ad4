"""Retail turnover and demand-season analytics expressed as Spark DataFrame plans."""
