"""Lectern: a PySpark engine that turns web pages and plain text into speech-ready utterances."""
