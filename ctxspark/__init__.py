"""ctxspark: a PySpark-native analytics engine for corpora, code, traces and event logs."""
