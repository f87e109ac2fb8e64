"""harrow: a PySpark-native lead enrichment and text data engine.

Layers: ``sources`` read tables and rule files, ``functions`` hold column
expressions, ``operators`` hold DataFrame -> DataFrame steps, ``plans`` compose
them into whole queries and ``streaming`` has the Structured Streaming forms.
The optional ``llm`` subpackage adds training-data operators; nothing outside it
imports it.
"""

__version__ = "0.1.0"
