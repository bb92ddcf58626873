"""Document-object and binary-codec analytics on Spark."""
