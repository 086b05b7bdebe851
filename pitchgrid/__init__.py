"""Match-event analytics as whole-table Spark jobs: DataFrame in, DataFrame out."""

import sys

from pyspark import cloudpickle

# Python helpers used inside tasks travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
