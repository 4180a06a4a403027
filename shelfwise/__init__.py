"""shelfwise: weekly retail sales intelligence on Spark DataFrames.

Resolve messy feed spellings against alias tables, clean and impute the
feeds, build a conformed star schema, and answer metric, comparison and
trend questions on it.  Every public function takes DataFrames and returns
DataFrames; nothing is collected on the driver except bounded lookup tables
whose size is checked first.
"""

__version__ = "0.1.0"
