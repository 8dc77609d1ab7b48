"""Reading and writing: label tables, file parts in natural order, reports."""
