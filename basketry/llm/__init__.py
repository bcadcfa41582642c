"""Operators for preparing training corpora.

Nothing outside this subpackage imports it. Each module holds one operator with a
general interface; :mod:`basketry.llm.registry` holds the thin queries over the
``documents`` and ``benchmark`` tables.
"""
