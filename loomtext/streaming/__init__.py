"""The streaming forms of the batch plans."""
