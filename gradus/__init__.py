"""gradus — Spark-native ranking evaluation, data preparation and weight algebra.

Every operator is a lazy function ``DataFrame -> DataFrame`` built from the
DataFrame API, so Catalyst plans, prunes and pushes down the whole pipeline.
"""

__version__ = "0.1.0"
