"""quizmart — quiz-platform analytics as PySpark DataFrame and Structured Streaming jobs.

Sub-packages:

* ``sources``   — readers/writers (COPY text, JSON, events) and the stand-in views over the driver tables
* ``functions`` — Column-expression scalars (search, labels, validation rules, ...)
* ``operators`` — DataFrame operators: data quality, reports, change application, sessions, nesting
* ``plans``     — the registered queries and their DuckDB oracle SQL
* ``streaming`` — Structured Streaming twins of the batch operators
"""

from quizmart.session import get_session, checkpoint_root  # noqa: F401

__all__ = ["get_session", "checkpoint_root"]
