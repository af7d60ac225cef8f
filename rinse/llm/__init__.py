"""Operators for preparing the training data of language models; nothing else in rinse needs them."""
