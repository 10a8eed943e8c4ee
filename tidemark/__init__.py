"""Keep destination tables in step with source tables, on Spark.

Sources (files, open tables, paged JSON responses) are read incrementally,
shaped with DataFrame operators and written to one or many destinations by
Structured Streaming jobs. See README.md for the map of modules.
"""

import sys

from pyspark import cloudpickle

# Functions handed to executors are shipped by value, so a cluster needs no
# install of this package beyond the driver.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
