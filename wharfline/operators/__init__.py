"""The engine's operators over books: a dataclass of DataFrames (see ``books.py``)."""
