"""Cleaning, profiling, analysis and modelling of wide site tables on Spark."""
