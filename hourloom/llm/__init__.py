"""Operators for preparing training text: decontamination, secrets, near copies, tokens, quality, mixing, sharding."""
