"""Training-data operators (token counts, dedup, packing, scans, search, sharding, chat).

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin ``opN_*`` queries; every operator module keeps its own general interface.
"""
