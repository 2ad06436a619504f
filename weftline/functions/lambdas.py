"""Functions that take a Python function over Columns."""

from pyspark.sql import functions as F

transform, filter_, exists, for_all = F.transform, F.filter, F.exists, F.forall
aggregate, zip_with, array_sort_comparator = F.aggregate, F.zip_with, F.array_sort
map_filter, map_zip_with, transform_keys, transform_values = F.map_filter, F.map_zip_with, F.transform_keys, F.transform_values
