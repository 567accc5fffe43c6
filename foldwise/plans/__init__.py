"""Registered queries and their SQL counterparts."""

from importlib import import_module

FAMILIES = ("splits", "profiles", "features", "texts", "metrics", "forensic", "blends", "calibration", "storage", "models")


def load_all() -> None:
    """Import every query family so that it registers its queries."""
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
