"""Point-in-time sports analytics on PySpark: operators, sources, functions, plans and streams.

Functions that run inside tasks travel with the job by value, so executors need no copy of this
package on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
