"""Tidewright: cleaning, features, regression and attribution for sensor time series on Spark."""
