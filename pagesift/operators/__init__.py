"""Relational operators over documents, pages, labels, embeddings and scores."""
