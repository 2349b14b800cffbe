"""Lumensift: document retrieval, chat analytics and text-corpus jobs on Spark."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
