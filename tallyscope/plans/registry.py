"""All registered queries: importing the modules fills ``QUERIES`` and ``SQL``."""

from . import queries as _core  # noqa: F401
from . import queries_more as _more  # noqa: F401
from . import queries_judge as _judge  # noqa: F401
from . import queries_stream as _stream  # noqa: F401
from . import queries_io as _io  # noqa: F401
from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
