"""Text and corpus operators over the project's records (notes, logs, briefs, clips, embeddings)."""
