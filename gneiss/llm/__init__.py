"""Corpus-preparation operators for training data. Nothing else in the package imports this."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["gneiss"])
