"""Column functions: built-in ones in ``text``, Arrow ones where Spark has none in ``arrow``."""
