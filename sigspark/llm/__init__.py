"""Training-data pipeline operators (language ID, mixing, dedup, ...).

Nothing else in the library imports this subpackage.  ``queries.py`` holds the
registered queries; each operator module keeps its own general interface.
"""
