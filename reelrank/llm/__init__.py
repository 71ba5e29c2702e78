"""Training-data operators over a ``documents`` table.

One module per operator; ``queries`` registers one query per operator and
``oracle`` holds the DuckDB SQL of those that SQL can express.  Nothing
outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to the executors by value, so a worker need not find it on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
