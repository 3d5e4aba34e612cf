"""The registered queries, grouped by subject."""


def load():
    """(queries, comparison SQL), every subject module imported."""
    import importlib

    for name in _SUBJECTS:
        importlib.import_module(f"catalog.{name}")
    from catalog.registry import ORACLES, QUERIES

    return QUERIES, ORACLES


_SUBJECTS = ["text_queries", "store_queries", "sign_queries", "workflow_queries", "road_queries", "stream_queries"]
