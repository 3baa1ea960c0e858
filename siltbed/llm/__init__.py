"""Training-data operators: ten documented methods over documents and pages.

Nothing else in the library imports this subpackage.
"""
