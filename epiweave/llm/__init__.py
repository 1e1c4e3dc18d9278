"""Operators for preparing training text: filters, deduplication, mixing.

Documents are rows with a ``doc_id`` and a ``text``; further columns are allowed
and are never read unless an operator names them. Working columns take names that no
column of the documents has; where a result is a column beside the documents' own, the
operator's docstring names it, and an own column of that name is replaced.
"""
