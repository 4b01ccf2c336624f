"""tidemark: monthly macro and cross-asset analytics as PySpark DataFrame operators."""
