"""Keyed snapshots, uncertain observations and event logs as Spark plans."""

from importlib import import_module

#: What the library offers by name, and where it is; imported when it is first asked for.
_PLACES = {
    "Snapshot": "attesta.operators.snapshots",
    "Difference": "attesta.operators.snapshots",
    "Merge": "attesta.operators.snapshots",
    "Cache": "attesta.sources.cached",
    "Policy": "attesta.sources.cached",
    "catalogue": "attesta.sources.readers",
    "account": "attesta.sources.readers",
    "images": "attesta.sources.readers",
    "resolved": "attesta.sources.readers",
    "consensus": "attesta.operators.consensus",
    "expectations": "attesta.operators.rewards",
    "multiplier": "attesta.operators.rewards",
    "totals_by_item": "attesta.operators.rewards",
}

__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(import_module(_PLACES[name]), name)
