"""Operators on free text: canonical values, look-alike characters, names, tokens, leaks, truncation."""
