"""Text and algorithm operators for training data. Optional: nothing outside this folder imports it."""
