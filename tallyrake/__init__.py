"""tallyrake: survey calibration and tracking as Spark DataFrame operators.

Layout
------
sources/    readers and writers: survey CSV, census margin dimension, run ledger,
            training history, and the survey view over the driver tables.
functions/  column expressions (recodes, calendar buckets) and the small
            special-function helpers used for p-values.
operators/  clean, normalise, rake, tracking, intervals, report, tests, impute.
plans/      the two end-to-end flows of the reference (process, dashboard).
streaming/  incremental re-weighting of touched windows from a file stream.
"""

import sys as _sys

# Ship the library's functions to Python workers by value, so executors need no
# installed copy of the package (pandas UDF closures reference module helpers).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from tallyrake.session import get_spark, checkpoint_dir  # noqa: F401,E402

__all__ = ["get_spark", "checkpoint_dir"]
