"""tallyfold: checking of business documents as Spark relations.

Words, rows, fields, tables, totals, citations and data-quality findings are all
DataFrames; every operator takes DataFrames and returns DataFrames.
"""

__version__ = "0.1.0"
