"""reelrank: Spark-native recommendation analytics over interaction tables.

Every operator takes and returns DataFrames.  Model fits, writes, and the
operators that cut lineage (activity filter, rankings, indexing) run jobs.
Sub-packages:

* ``sources``   – readers, writers, materialisation gate, test-table views
* ``functions`` – Column-level helpers (title cleaning, ordered lists, JSON detail projection)
* ``operators`` – ratings filters, baskets, association rules, ALS, popularity, search, feeds
* ``plans``     – the registered queries and their SQL oracles
* ``llm``       – training-data operators (optional)
"""

__version__ = "0.1.0"
