"""Operators on text corpora for training data. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so workers need no installed copy of this folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
