"""Operators of a training-data pipeline: de-duplication, token counts, language, privacy, search, packing, files."""
