"""Operators for training-data pipelines; nothing else in the library imports them.

Functions of this package travel to Python workers by value: executors need
Spark's Python dependencies, but no copy of the package.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
