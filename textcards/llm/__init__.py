"""Training-data operators: the numbered operators op1..op10 and their queries.

Nothing else in the package imports this subpackage.  Task code (functions
run by ``mapInArrow``) is pickled by value, so executors only need numpy and
pyarrow, not this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(*modules: str) -> None:
    """Pickle the named modules of this subpackage by value from now on."""
    for m in modules:
        cloudpickle.register_pickle_by_value(sys.modules[m])
