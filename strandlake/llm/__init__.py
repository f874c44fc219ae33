"""Training-data operators: extraction, de-duplication, tokenising, packing, archiving.

Self-contained: the rest of the library never imports this subpackage.
"""
