"""Operators over DataFrames, general in their inputs."""
