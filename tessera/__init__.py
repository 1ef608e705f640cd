"""A Spark-first toolkit for mixed text, graph, time-series and relational data.

Every operator is a function from DataFrame to DataFrame.  Sub-packages:

* ``functions``  column expressions (text, dates, maths, nested paths, comparison directives)
* ``operators``  relational, sequence, search, graph and data-maintenance operators
* ``sources``    delimited, JSON, text and list storage readers and writers
* ``plans``      scatter/gather and resumable step graphs
* ``streaming``  queues, idle sessions, replay
"""

__version__ = "0.1.0"
