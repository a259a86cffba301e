"""Training-data operators. Nothing else in the library imports this subpackage.

The worker-side functions are pickled by value, so executors need not have the
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
