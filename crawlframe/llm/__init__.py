"""Operations of a training-data pipeline over documents and pages."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code: these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
