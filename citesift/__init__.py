"""citesift: evidence retrieval, fusion, budgeting and scoring as Spark jobs.

Sub-packages:

* ``sources``   – table readers (parquet views, nested JSON, text files, attribute-value scans)
* ``sinks``     – snapshot writers (upsert by key, manifest replace, archives, DLQ, reports)
* ``functions`` – column expressions (hashed embeddings, digests, prompts, text clean-up)
* ``operators`` – relational building blocks (k-NN joins, rank fusion, budget gate, trace windows,
                  manifest diff, attempt classification, evaluation and quality metrics)
* ``plans``     – composite jobs (index, reindex, agentic loop, single shot, evaluation, quality report)
* ``streaming`` – Structured Streaming variants of the counter, gate, intake and reindex
"""

__version__ = "0.1.0"
