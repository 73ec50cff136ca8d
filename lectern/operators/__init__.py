"""Operators: extraction of blocks from pages, utterances from blocks, accounting of their synthesis."""
