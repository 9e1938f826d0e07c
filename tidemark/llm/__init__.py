"""Training-data operators: thirteen operators over the document and embedding tables, and their queries.

Nothing else in the library imports this subpackage.
"""
