"""All queries of the library's own operators by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from . import metric_queries, path_queries, sampling_queries, scene_queries, source_queries, stream_queries, track_queries  # noqa: F401  (they register)
from .bind import ORACLE_SQL, QUERIES, query

TERMS = metric_queries._TERMS


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, {w}::DOUBLE AS weight, (SELECT loss FROM ({ORACLE_SQL[q]})) AS loss" for n, (w, q) in TERMS.items()).join(("WITH terms AS (", ") SELECT name, weight, loss, round(sum(weight * loss) OVER (), 3) AS total FROM terms")))
def total_training_loss(spark, sf_dir):
    """The terms of a training step, weighed and added up."""
    from pyspark.sql import functions as F

    from ..operators.losses import total_loss

    out = total_loss({n: (w, QUERIES[q](spark, sf_dir).select(F.col("loss"))) for n, (w, q) in TERMS.items()})
    return out.withColumn("total", F.round("total", 3))


__all__ = ["ORACLE_SQL", "QUERIES"]
