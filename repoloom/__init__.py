"""Source-code and document knowledge bases as Spark DataFrames.

Every public function takes and returns DataFrames (or builds Column
expressions), so jobs stay lazy until the caller writes or collects them.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
