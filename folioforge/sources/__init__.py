"""Readers of files into blocks, and table stores."""
