"""Document-record analytics as Spark jobs.

Operators are plain ``DataFrame -> DataFrame`` functions and column expressions. Nothing
here starts an action unless its docstring says so (sinks, streams and the size check of
``retrieval.vector_top_k``).
"""

__version__ = "0.1.0"
