"""Query registry."""


def all_queries():
    from . import queries

    return dict(queries.REGISTRY)
