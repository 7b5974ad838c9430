"""clearspark: a Spark-first engine that undoes disguises in text, at scale."""
