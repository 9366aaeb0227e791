"""Dimension joins: operator, transfer operator, route, origin and destination names,
and fare-product descriptions.

All are left equi-joins on small lookups. No broadcast hint is forced: Spark's
``autoBroadcastJoinThreshold`` (planning-time size estimate) and AQE (runtime
size) broadcast a lookup only while it is actually small, and fall back to a
shuffle join beyond that. A repeated lookup key fans rows out, as a join does;
nothing is deduplicated silently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def make_human_readable(tr: DataFrame, participants: DataFrame, routes: DataFrame,
                        locations: DataFrame) -> DataFrame:
    """Five left joins adding operator, transfer-operator, route and location names.

    Location codes arrive as text and are cast to int first (``try_cast``:
    a malformed code becomes null instead of failing the job). The destination
    name is resolved under the *tapping* operator. The two participant joins
    and the two location joins read the same lookup plan, so a broadcast of
    each lookup is built once and reused.
    """
    t = tr.withColumns({
        "originlocation": F.expr("try_cast(originlocation as int)"),
        "destinationlocation": F.expr("try_cast(destinationlocation as int)"),
    }).alias("t")
    p = participants.select("participantid", "participantname")
    r = routes.select("participantid", "routeid", "routename").alias("r")
    loc = locations.select("participantid", "locationcode", "locationname")
    p1, p2, lo, ld = p.alias("p1"), p.alias("p2"), loc.alias("lo"), loc.alias("ld")
    c = F.col
    out = (
        t.join(p1, c("t.operatorid") == c("p1.participantid"), "left")
        .join(p2, c("t.transferoperator") == c("p2.participantid"), "left")
        .join(r, (c("t.operatorid") == c("r.participantid")) & (c("t.routeid") == c("r.routeid")), "left")
        .join(lo, (c("t.originlocation") == c("lo.locationcode")) & (c("t.operatorid") == c("lo.participantid")),
              "left")
        .join(ld, (c("t.destinationlocation") == c("ld.locationcode"))
              & (c("t.operatorid") == c("ld.participantid")), "left")
    )
    return out.select(
        *[c(f"t.{name}").alias(name) for name in tr.columns],
        c("p1.participantname").alias("participantname"),
        c("p2.participantname").alias("participantname_transfer"),
        c("r.routename").alias("routename"),
        c("lo.locationname").alias("locationname_origin"),
        c("ld.locationname").alias("locationname_destination"),
    )


def product_meta(contract_map: DataFrame, products: DataFrame) -> DataFrame:
    """Contract-type map joined to product text on (issuerid, producttype)."""
    return contract_map.join(products, ["issuerid", "producttype"], "inner")


def get_product_description(tr: DataFrame, contract_map: DataFrame, products: DataFrame,
                            keep_category: bool = False) -> DataFrame:
    """Left-join the product description on (contractid, operatorid).

    As in the source model both ``productcategory`` copies and
    ``producttype`` are dropped; ``keep_category=True`` keeps the
    transaction's own ``productcategory``. A null contract gets a null
    description (plain ``=`` join keys).
    """
    meta = product_meta(contract_map, products).select(
        F.col("contracttype").alias("contractid"),
        F.col("issuerid").alias("operatorid"),
        F.col("description").alias("product_description"),
    )
    out = tr.join(meta, ["contractid", "operatorid"], "left")
    keep = [c for c in tr.columns if keep_category or c != "productcategory"]
    return out.select(*keep, "product_description")
