"""printloom: recovers tables from printed pages, whose characters are rows of a DataFrame."""
