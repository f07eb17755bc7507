"""Page-level retrieval and its evaluation as DataFrame plans."""
