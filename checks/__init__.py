"""Registered queries: each pairs a Spark job over the driver tables with its SQL twin."""


def load():
    import importlib
    import pkgutil

    from checks import registry

    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"checks.{m.name}")
    return registry
