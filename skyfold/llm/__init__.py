"""Training-data operators: search, archives, deduplication, mixing, scoring, media and packing.

Nothing else in the package imports this subpackage; ``__spark_entry__`` adds its queries when it is there.
"""

from pyspark import cloudpickle

# Functions sent to executors travel by value, so a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(__import__(__name__, fromlist=["_"]))
