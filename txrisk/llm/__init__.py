"""Operators for preparing training data of language models; nothing else in txrisk imports them."""
