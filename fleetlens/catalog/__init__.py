"""The registered queries."""

from importlib import import_module
from pkgutil import iter_modules


def load():
    """(queries, sql twins), from every module of this package."""
    for m in iter_modules(__path__):
        import_module(f"{__name__}.{m.name}")
    from fleetlens.catalog.base import QUERIES, SQL

    return QUERIES, SQL
