"""Document preparation, retrieval and evaluation as DataFrame plans."""
