"""Text guard and usage metering on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job; executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from glyphgate.operators.guard import guard, guard_context, public_view  # noqa: E402
from glyphgate.operators.integrity import signatures  # noqa: E402
from glyphgate.operators.personal_data import personal_data  # noqa: E402
from glyphgate.plans.scan import scan, scan_dedup, scan_hybrid  # noqa: E402

__all__ = [
    "guard", "guard_context", "personal_data", "public_view", "scan", "scan_dedup", "scan_hybrid", "signatures",
]
