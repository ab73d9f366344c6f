"""Operators for preparing large text collections.

Each module holds one operator with a general interface; ``queries`` applies
them to the test tables and ``oracles`` has the SQL that checks them. Nothing
else in the library imports this subpackage.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
