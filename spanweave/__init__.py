"""spanweave: a Spark-native data engine for sequence-to-sequence corpora.

Layout
------
``functions``  Column -> Column building blocks (md5 ranks, array HOFs, masks, text).
``operators``  DataFrame -> DataFrame operators (vocabulary, corruption, packing,
               phrases, formatting, splits, metrics, run-log analytics).
``sources``    readers and writers (corpora, task splits, phrases, caches, sinks).
``plans``      derived inputs built from the shared test tables and composed plans.
``streaming``  Structured Streaming versions of the corpus pipelines.
"""

from spanweave.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir"]
