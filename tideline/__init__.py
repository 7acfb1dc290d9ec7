"""Multi-stage recommendation analytics and training-data operators on Spark."""
