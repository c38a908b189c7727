"""Spark engine for searchable, cited chunk corpora over many repositories."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks are shipped with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
