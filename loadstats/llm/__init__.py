"""Operators for preparing language-model training data.

Every module here stands on its own general helpers in :mod:`.common`; nothing
outside this subpackage imports it.
"""
