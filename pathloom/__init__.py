"""pathloom: graph-context retrieval for schema matching, written for Spark."""
