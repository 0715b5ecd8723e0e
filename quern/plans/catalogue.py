"""All queries over the driver tables, by name, with the SQL they must equal."""

from quern.plans import aggregates, io_sql, learning, relational, reshaping, scalars, surface, windows  # noqa: F401
from quern.plans.base import ORACLES, QUERIES  # noqa: F401
