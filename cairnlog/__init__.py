"""Log analytics as Spark DataFrame operators.

Text lines become a *log frame* -- one row per entry, its keys in a
``fields`` map -- and every operator takes and returns a DataFrame (predicates
return a boolean Column), so the same code serves batch and, where no state is
needed, Structured Streaming.  Operators that take a field name work on a log
frame (``fields[name]``) and on an ordinary table (column ``name``) alike.
"""

__version__ = "0.1.0"
