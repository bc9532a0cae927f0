"""Small-area risk analytics and training-data operators as Spark plans."""
