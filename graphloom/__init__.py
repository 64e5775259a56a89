"""Knowledge-graph and ranked-retrieval analytics on PySpark DataFrames."""
