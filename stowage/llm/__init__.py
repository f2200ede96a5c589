"""Operators for training-data pipelines over document corpora.

One module per operator; nothing outside this subpackage imports it. Every
operator takes a DataFrame plus column names and returns a DataFrame; state
that must outlive a lost executor is written to the folder named by
``spark.checkpoint.dir`` (see :mod:`stowage.llm.shared`).
"""
