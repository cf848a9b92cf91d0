"""Training-data operators over text, page and vector tables.

Nothing else in the package imports this subpackage.
"""
