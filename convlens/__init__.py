"""convlens: conversation analytics written as Spark DataFrame / SQL / MLlib plans.

Layout
------
sources/    readers and writers (CSV transcripts, scores, feature tables, reports)
functions/  pure Column expressions (no Spark action, no shuffle)
operators/  DataFrame -> DataFrame operators grouped by topic
plans/      compositions of operators (end-to-end pipelines, driver queries)
streaming/  the same per-row feature expressions applied to a streaming source
"""

from convlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
