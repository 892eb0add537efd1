"""turnwise: task-oriented dialogue data jobs on Spark.

Operators are plain functions ``DataFrame -> DataFrame`` (``turnwise.operators``) or
``Column -> Column`` (``turnwise.functions``). Sources and sinks live in
``turnwise.sources``, end-to-end jobs and the query registry in ``turnwise.plans``,
and the keyed session state machine for Structured Streaming in ``turnwise.streaming``.
"""

__version__ = "0.1.0"
