"""Spark analytics for time series, labelled arrays, spatial fields and meshes."""
