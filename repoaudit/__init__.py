"""Repository audits at fleet scale: DataFrame-to-DataFrame functions keyed by repository."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so a cluster needs no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
