"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it. Every operator is a function over
DataFrames; ``queries.py`` holds the registered ``opN_<name>`` queries.
"""

import os

# The matrices here are small: more BLAS threads in one process only spin. Read when numpy loads.
os.environ.setdefault("OMP_NUM_THREADS", "1")
