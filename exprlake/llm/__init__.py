"""Operators of a training-data pipeline: documents, embeddings and labels in, decisions about them out."""
