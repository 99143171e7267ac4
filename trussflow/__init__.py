"""trussflow: a Spark-first analytics engine for building-information entity graphs.

Every operator is declared with DataFrame / SQL expressions and left to Catalyst; Arrow functions are used only
where the built-ins cannot express the semantics (recursive JSON of unknown shape, sequence labelling, mesh maths).
"""

import sys

from pyspark import cloudpickle

# Arrow functions are sent to executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
