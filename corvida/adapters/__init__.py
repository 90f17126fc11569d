"""Adapter surface: what turns files into units, units into Markdown, text into vectors and candidates into scores."""
