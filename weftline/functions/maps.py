"""Map functions; a key that comes twice is an error."""

from pyspark.sql import functions as F

map_keys, map_values, map_entries, map_contains_key = F.map_keys, F.map_values, F.map_entries, F.map_contains_key
map_from_arrays, map_from_entries, map_concat = F.map_from_arrays, F.map_from_entries, F.map_concat
