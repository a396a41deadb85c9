"""DataFrame jobs over page-level detection tables, and training-data operators."""
