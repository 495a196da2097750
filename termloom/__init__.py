"""termloom: terminology analytics and training-data operators as PySpark DataFrame jobs."""
