"""breachlens — incident SLA-risk analytics as lazy Spark DataFrame operators.

Every public operator takes a DataFrame (plus parameters) and returns a
DataFrame without triggering an action, except where noted (model fitting,
quantile boundaries of the rank helper, file sinks).
"""

from breachlens.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
