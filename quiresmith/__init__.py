"""Document reconstruction on Spark: lines, words and layout blocks in, ordered Markdown out."""
