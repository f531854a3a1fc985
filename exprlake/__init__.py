"""exprlake: Spark DataFrame operators for large sample-by-feature matrices.

Tables come in three plain shapes: long measurements ``(sample_id, feature,
value)``, packed vectors ``(key, vec)`` and long memberships / edges / scores.
Every operator takes DataFrames and returns a lazy DataFrame.
"""

import sys

from pyspark import cloudpickle

from exprlake.session import build_session, scratch_dir

# functions that run inside tasks travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "scratch_dir"]
