"""Book-text structuring on Spark: raw text to paragraphs, chapters and EPUB."""
