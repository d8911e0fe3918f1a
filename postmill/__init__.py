"""Recipient-list intake and delivery-log analytics, written as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that workers need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
