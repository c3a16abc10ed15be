"""Peptide-MHC and antigen-processing analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
