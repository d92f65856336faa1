"""Operators that prepare a text corpus for language-model training.

Each module holds one operator with a general interface; ``queries`` binds them to the tables of the
driver and to the result columns of their contracts.  All of them take any DataFrame with a document id
and a text column, ignore other columns, read null text as empty and never mutate their input.
"""
