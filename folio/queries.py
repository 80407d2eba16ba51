"""The registered queries over the given tables, and the SQL that each is held against."""

from .plans import audit, corpus, derived, drafts, evaluation, judged, more, prose, relational, retrieval, scalars, staged, streams  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
