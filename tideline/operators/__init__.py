"""Operators of the recommender: DataFrame in, DataFrame out."""
