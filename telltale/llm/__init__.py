"""Operators for preparing training text: scans, search, duplicates, scoring, mixing, chat and tokens."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors with their code, wherever it is installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
