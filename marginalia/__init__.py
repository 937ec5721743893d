"""Reading and knowledge-graph analytics written against the PySpark DataFrame API."""
