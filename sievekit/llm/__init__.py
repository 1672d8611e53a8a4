"""Operators of a training-data pipeline. Nothing else in the library imports
this package; its queries are in ``llm.registry``.

The functions that run inside Python workers are pickled by value, so the
executors need no installed copy of the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
