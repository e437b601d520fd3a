"""tidemark: record synchronisation and training-data operators on PySpark."""
