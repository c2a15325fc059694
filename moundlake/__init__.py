"""Stockpile survey analytics as Spark jobs.

Points, raster cells, polygons and heap records are DataFrames keyed by
``survey_id``; every operator takes DataFrames and returns DataFrames, so one
job covers many surveys at once.
"""

__version__ = "0.1.0"
