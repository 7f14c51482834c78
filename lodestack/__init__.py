"""lodestack: retrieval analytics as Spark DataFrame plans.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to DataFrame),
``sources`` (corpora, evaluation sets, bundles), ``plans`` (the query catalogue and its SQL),
``streaming`` (incremental ingestion).
"""
