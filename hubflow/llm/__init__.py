"""Operators for building training data from a table of documents.

Each module holds one operator with its own general interface; ``queries.py``
registers the thin ``opN_`` queries. Nothing else in the library imports this
package.
"""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code: the package needs no
# installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
