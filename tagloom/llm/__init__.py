"""Corpus preparation: extraction, duplicates, secrets, personal data, quality, mixing, packing."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules["tagloom"])
