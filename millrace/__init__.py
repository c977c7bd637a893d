"""millrace: Spark-native operators for model-training and evaluation data.

Every operator is a function over ``DataFrame`` or ``Column``; nothing holds a
session.  ``millrace.llm`` (operators on text corpora) is optional: no module
outside that subpackage imports it.
"""

__version__ = "0.1.0"
