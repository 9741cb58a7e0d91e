"""canopy: polygon overlay analytics on PySpark.

Layers are ordinary DataFrames. A *shape layer* carries, next to its own
attributes, the derived geometry columns built once by
:func:`canopy.functions.geometry.with_shape`:

``edges``  ARRAY<STRUCT<ax,ay,bx,by DOUBLE>>  shells counter-clockwise, holes clockwise
``x0, y0, x1, y1``  bounding box
``area``  planar area in CRS units

Everything heavy (grid join, edge-pair overlay, aggregation) is DataFrame
work planned by Catalyst; Python runs only as small Arrow-batched helpers
(WKB codec, geometry repair).
"""

__all__ = ["functions", "operators", "plans", "sources"]

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python helpers (Arrow UDFs, grouped-map functions) travel to executors by
# value, so workers do not need this package installed to run them.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
