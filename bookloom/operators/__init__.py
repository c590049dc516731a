"""Operators over books, blocks, headings, chapters and their measures."""
