"""Media-and-markets analytics expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: the few Python helpers travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
