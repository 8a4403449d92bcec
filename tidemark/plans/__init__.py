"""Registered queries and their SQL twins."""

from importlib import import_module

MODULES = ["shapes", "sources", "bars", "features", "pit", "asset_signals", "panel_signals", "event_signals", "combinators",
           "news", "fundamentals", "options", "outcomes", "metrics", "research", "learning", "positions", "streams"]


def load():
    """Import every query module and return the catalog."""
    catalog = import_module(f"{__name__}.catalog")
    for m in MODULES:
        import_module(f"{__name__}.{m}")
    catalog.finish()
    return catalog
