"""Training-data operators: each module is one operator with its query.

``registry()`` gives the queries and their SQL; nothing outside this package
imports it except the entry module's guarded hook.
"""
