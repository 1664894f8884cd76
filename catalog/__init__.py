"""Registered queries over the given tables, and the SQL that checks them."""

from pyspark import cloudpickle

import catalog
import sftprep

# The queries run from a checkout: send the code of their Arrow functions along with the
# tasks, since the Python workers need not find these packages. An installed package, or
# spark.submit.pyFiles, does without.
for package in (catalog, sftprep):
    cloudpickle.register_pickle_by_value(package)
