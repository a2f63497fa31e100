"""Files of structured formats as rows, and rows as files. A file is a row (path, content)."""
