"""A PySpark-native analytics engine."""

import sys

from pyspark import cloudpickle
from pyspark.sql import Row, Window, WindowSpec  # noqa: F401

from quern.frame import Frame, Grouped  # noqa: F401
from quern.session import Session, get_active_session, set_active_session  # noqa: F401

DataFrame = Frame

# Functions that run in Python workers are pickled by value: a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
