"""weftline: a typed analytics layer and training-data toolkit written on PySpark DataFrames."""
