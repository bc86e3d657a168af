"""loomgraph: graph analytics and corpus preparation written as Spark DataFrame plans."""
