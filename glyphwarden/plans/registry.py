"""All registered queries and their SQL equivalents."""

from functools import wraps

from glyphwarden.plans import detection_queries, history_queries  # noqa: F401 - registers on import
from glyphwarden.session import apply_settings


def _with_settings(query):
    """Registered queries run in sessions made elsewhere; the operators leave settings alone."""

    @wraps(query)
    def run(spark, folder):
        return query(apply_settings(spark), folder)

    return run


QUERIES = {name: _with_settings(query) for name, query in detection_queries.QUERIES.items()}
ORACLES = detection_queries.ORACLES
