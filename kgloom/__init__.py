"""Knowledge-graph, benchmark and corpus operators on PySpark DataFrames."""
