"""Forecast-verification analytics and corpus operators, built on Spark DataFrames."""
