"""Training-data operators (documents, pages, conversations) on Spark DataFrames.

Functions of this subpackage that run inside Python workers are shipped by value,
so executors need the third-party libraries but not this repository.
"""

from pyspark import cloudpickle

import tallywright.llm as _self

cloudpickle.register_pickle_by_value(_self)
