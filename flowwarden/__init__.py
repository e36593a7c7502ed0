"""Network-flow threat analytics on PySpark."""
