"""All registered queries of the solar-shading operators and their SQL twins."""

from __future__ import annotations

from heliofield.plans import audits, clocks, cloud, files, light, power, shapes

GROUPS = (cloud, light, power, clocks, shapes, files, audits)


def _all():
    return {k: v for g in GROUPS for k, v in g.queries().items()}


def queries():
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql():
    return {k: sql for k, (_, sql) in _all().items() if sql}
