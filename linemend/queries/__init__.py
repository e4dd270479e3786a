"""Every operator as a query over the given tables, with equivalent SQL where there is any.

A query module holds `QUERIES: {name: (function(spark, dir) -> DataFrame, sql or None)}`.
"""

from __future__ import annotations

from . import catalogs, checking, codelists, conversion, profiling, repairing, schemas, typing_, webpages

MODULES = (repairing, typing_, schemas, catalogs, codelists, checking, webpages, profiling, conversion)

ALL = {name: entry for module in MODULES for name, entry in module.QUERIES.items()}
