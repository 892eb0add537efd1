"""Booking checks: compare a booking request with the goal's booking, issue references."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import python_bool


def deterministic_ref(key: Column, modulus: int = S.BOOK_REF_MODULUS) -> Column:
    """Reproducible stand-in for a random reference in 1..modulus (first 32 bits of md5)."""
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint")
    return (h % modulus + 1).cast("bigint")


def book_result(df: DataFrame, request: Column, goal: Column, domain: str = "domain", key: str = "request_id",
                oracle_ref: str | None = None, ignored: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """Per row: ``success`` (NULL when the request is incomplete) and ``ref``.

    ``request`` is the ``map<slot, value>`` of every booking slot of the domain; ``goal`` the
    goal's booking map, never NULL (absent keys = not part of the goal). Any falsy request value -> (NULL,
    NULL). Ignored slots (taxi) are dropped from the request, and from the goal only when the
    request has them. Success needs whole-map equality, so an extra goal key is a failure.
    """
    ignored = ignored if ignored is not None else {"taxi": S.TAXI_IGNORED_BOOK_SLOTS}
    complete = F.forall(F.map_values(request), lambda v: v.isNotNull() & (v != ""))
    req, gl = request, goal
    for dom, slots in ignored.items():
        lst = F.array(*[F.lit(s) for s in slots])
        req = F.when(F.col(domain) == dom, F.map_filter(req, lambda k, v: ~F.array_contains(lst, k))).otherwise(req)
        gl = F.when(F.col(domain) == dom, F.map_filter(
            gl, lambda k, v: ~(F.array_contains(lst, k) & F.map_contains_key(request, k)))).otherwise(gl)
    equal = F.array_sort(F.map_entries(req)) == F.array_sort(F.map_entries(gl))
    success = F.when(complete, equal)
    ref_key = F.concat_ws("|", F.col(key).cast("string"), F.col(domain))
    given = F.col(oracle_ref) if oracle_ref else F.lit(None).cast("bigint")
    ref = F.when(success, F.coalesce(F.when(given != 0, given), deterministic_ref(ref_key)))
    return df.withColumn("success", success).withColumn("ref", ref.cast("bigint"))


def book_result_text(domain: Column, success: Column, ref: Column, with_domain: bool = True) -> Column:
    """"domain success True, domain ref N"; falsy values (False, NULL) are not printed."""
    head = F.concat(domain, F.lit(" ")) if with_domain else F.lit("")
    parts = [F.when(success, F.concat(head, F.lit("success "), python_bool(success))),
             F.when(ref.isNotNull() & (ref != 0), F.concat(head, F.lit("ref "), ref.cast("string")))]
    return F.coalesce(F.concat_ws(", ", *parts), F.lit(""))
