"""Registered queries over the given tables, each with its SQL twin."""

import functools

MODULES = ("lexicon_queries", "match_queries", "text_queries", "translate_queries", "search_queries", "study_queries", "file_queries")


def registry() -> dict:
    import importlib

    from lexmill.session import tune

    def tuned(fn):
        @functools.wraps(fn)
        def run(spark, sf):
            return fn(tune(spark), sf)

        return run

    out = {}
    for module in MODULES:
        for name, (fn, sql) in importlib.import_module(f"checks.{module}").QUERIES.items():
            out[name] = (tuned(fn), sql)
    return out
