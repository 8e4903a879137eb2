"""Category-share dynamics as Spark jobs: counts, shares, renewal model, grouping search."""

import sys

from pyspark import cloudpickle

# Tasks get the few Python functions they need with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
