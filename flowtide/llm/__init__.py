"""Operators of a training-data pipeline over tables of documents.

Every operator takes a DataFrame that holds at least ``doc_id`` and ``text``.
Unless its docstring says otherwise: a null text is an empty text, a null
``doc_id`` is a document of its own, repeated rows are separate documents, an
empty table gives an empty result, and further columns of any name are ignored
(or, where documents are returned, passed through).

Operators that need to find a row again number the rows of the scan; hand them
a stored table (as :func:`flowtide.llm.common.stored` makes), not a frame whose
row order can change between two reads.
"""
