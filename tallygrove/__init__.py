"""Token accounting over document corpora, as Spark jobs.

Scan or read documents, select them by path rules, count their tokens, filter by
token budget, and merge, report or roll them up along their paths. Results can be
kept in a versioned store, so that a later run measures only what has changed.
"""

import sys

from pyspark import cloudpickle

# Task code of this package travels inside the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
