"""Graph-pattern analytics on Spark: SPARQL 1.1 over RDF data and over relational tables seen as a virtual graph."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
