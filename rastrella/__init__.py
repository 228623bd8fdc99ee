"""Raster analytics on Spark: images as relations of pixels."""

import sys

from pyspark import cloudpickle

# Executors may not have this package; what they run travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
