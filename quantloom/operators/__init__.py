"""Operators over bars, signals, trades and equity curves."""
