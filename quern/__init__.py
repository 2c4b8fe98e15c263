"""quern: a PySpark-native engine for document catalogues, retrieval, ranking and reports."""
