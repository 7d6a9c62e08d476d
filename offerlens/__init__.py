"""offerlens: market-price analytics on Spark DataFrames.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns; nothing here collects data to the driver except where a docstring
says so (and then only rows of a fixed number).
"""

import sys

from pyspark import cloudpickle

# ship the package's small Python helpers with the tasks that use them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
