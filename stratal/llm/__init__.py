"""Operators for preparing language-model training data; nothing outside this subpackage imports it."""

from pyspark import cloudpickle

import stratal

# Functions run on executors travel with their code, so executors need no copy of this repository.
cloudpickle.register_pickle_by_value(stratal)
