"""Operators of a training-data pipeline: language, toxicity, near duplicates, packing, storage.

Nothing else in the library imports this package. Staged tables go to the folder that the session
names in ``spark.checkpoint.dir`` (or to the warehouse where that is unset).
"""
