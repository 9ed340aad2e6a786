"""quill — article-readership analytics as Spark jobs.

Sub-packages:

* ``sources``   — readers and writers (report CSV, staged tables, pages, HTML extraction)
* ``functions`` — ``Column`` expressions (parsing, URLs, dates, text, special functions)
* ``operators`` — DataFrame → DataFrame operators (filters, joins, aggregates, windows,
  features, sentiment, statistics, GLMs, association rules, Bayesian and neural fits)
* ``plans``     — the three end-to-end stages and the registered queries with SQL oracles
* ``streaming`` — notes on which operators are stream-safe (the workflow itself is batch)
"""

__all__ = ["session"]
