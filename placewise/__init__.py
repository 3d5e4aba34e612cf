"""Place (store) data analytics as PySpark DataFrame operators."""
