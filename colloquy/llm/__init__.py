"""Operators for training data from the boards: records, texts and labels made ready for language models."""
