"""Operations of a training-data pipeline, each a Spark job over DataFrames.

Nothing else in the library imports this subpackage.
"""
