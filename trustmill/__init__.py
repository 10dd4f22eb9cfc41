"""trustmill: dataset auditing and prediction-reliability analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with the job, so the package needs to be on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
