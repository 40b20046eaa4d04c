"""Text-research analytics on Spark: documents in, one token relation, every analysis a DataFrame."""
