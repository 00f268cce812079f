"""Operators that turn the documents of crawled storefronts into training data.

Nothing else in the package imports this one. Every operator takes rows of the reference tables (``page_id``, ``text``,
``html`` and so on) and leaves columns it does not know alone or out, as its docstring says.
"""
