"""Operators for preparing training text at scale.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin ``opN_*`` queries over the driver's
tables and their SQL.
"""
