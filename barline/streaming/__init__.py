"""Structured Streaming forms of the candle, signal and position rules."""
