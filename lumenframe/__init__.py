"""An analytics engine for PySpark: operators, transforms, guarded SQL, analyses and streaming windows over DataFrames."""
