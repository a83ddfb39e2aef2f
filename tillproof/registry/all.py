"""The registered queries, in the order of the operator inventory."""

from __future__ import annotations

from tillproof.registry import audits, checks, claim_checks, cleaning, io, profiles, scalars, stars
from tillproof.registry.base import Query

ALL: list[Query] = [
    *io.QUERIES, *scalars.QUERIES, *profiles.QUERIES, *cleaning.QUERIES, *audits.QUERIES, *stars.QUERIES,
    *checks.QUERIES, *claim_checks.QUERIES,
]
