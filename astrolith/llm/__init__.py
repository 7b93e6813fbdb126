"""Training-data operators: ten corpus components over documents and vectors.

Nothing outside this subpackage imports it; ``queries.py`` holds the
registered queries and their SQL.
"""
