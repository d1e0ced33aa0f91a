"""Operators for preparing training data: de-duplication, quality and URL rules, token counts and files, packing and mixing.

Nothing else in the library imports this subpackage."""
