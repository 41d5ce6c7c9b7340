"""gneiss: a Spark-native engine for document retrieval, log analytics and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors carry their code, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
