"""Instrument files as DataFrames: text formats by column expressions, binary records by small decoders."""
