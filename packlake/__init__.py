"""packlake: blob-referenced columnar datasets on PySpark."""
