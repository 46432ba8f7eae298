"""wordloom: multilingual text analytics as PySpark DataFrame operators."""
