"""Gridded climate analytics on Spark DataFrames.

operators/  axis, bounds, temporal, spatial, regridding and mask operators
sources/    Parquet datasets, time decoding, multi-file reads, netCDF-3
functions/  calendars and column expressions
plans/      registered queries and their SQL
streaming/  windowed averages over streams
llm/        operators for text corpora; nothing else imports it
"""
