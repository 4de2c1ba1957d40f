"""ticketlake: support-conversation analytics as Spark DataFrame jobs.

Sub-packages
------------
sources    scans of the given tables, CSV / JSON / text / binary-file readers, sinks
functions  column expressions (scalar rules, cosine, tokenizer) and the one Arrow UDF
operators  relational operators: KPIs, preparation, conversations, retrieval joins,
           vector block products, text features, evaluation metrics, change-sets, ML
plans      the registered driver queries and their DuckDB oracle SQL
streaming  Structured Streaming twins of the batch operators
"""

from ticketlake.session import get_session, checkpoint_dir  # noqa: F401

__all__ = ["get_session", "checkpoint_dir"]
