"""Clip analytics on Spark: curation, sampling, sequences, spectra, scoring, evaluation.

Every public function takes DataFrames or Columns and returns DataFrames or Columns.
"""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with the job, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
