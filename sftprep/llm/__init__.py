"""Operators of a training-data pipeline for language models; nothing else imports them."""
