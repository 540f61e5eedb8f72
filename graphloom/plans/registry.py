"""All queries of the library outside its optional subpackage."""

from __future__ import annotations

from ..sources import queries as _sources  # noqa: F401  (these modules register their queries)
from ..streaming import queries as _streaming  # noqa: F401
from . import evidence_queries as _evidence  # noqa: F401
from . import more_queries as _more  # noqa: F401
from . import report_queries as _reports  # noqa: F401
from . import resolution_queries as _resolution  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
