"""Document-corpus analytics and hybrid retrieval as Spark plans."""
