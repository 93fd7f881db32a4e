"""Spark operators for industrial sensor telemetry.

Every operator takes DataFrames and returns a DataFrame; the few fitted models are small objects
whose size does not depend on the input.
"""
