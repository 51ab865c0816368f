"""Label files as they arrive: an addition, the batch operators do the work."""
