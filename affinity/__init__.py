"""affinity: behavioural-affinity analytics on PySpark DataFrames."""
