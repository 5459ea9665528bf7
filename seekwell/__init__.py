"""seekwell: retrieval, dialogue search and search-log analytics on Spark DataFrames.

Every operator takes DataFrames and returns DataFrames.  Sub-packages:

``functions``  column expressions (text analysis, document rendering)
``operators``  retrieval, routing, budgets, dialogue, log analytics, evaluation
``sources``    readers, writers and incrementally maintained tables
``plans``      compositions (hybrid search, index build)
``streaming``  Structured Streaming forms of the log operators
"""
