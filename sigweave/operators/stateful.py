"""What holds a session together beyond one identity: tunnels that follow each other, access ids and service identities that meet a subscriber."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigweave.functions import fields
from sigweave.operators.seeds import gap_segments
from sigweave.operators.sessions import first_of

# Messages that show a mobility procedure.
MOBILITY = ["HANDOVER", "FORWARD RELOCATION", "MODIFY BEARER", "RELEASE ACCESS BEARERS", "PATH SWITCH", "UE CONTEXT RELEASE"]


def _tokens(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, token) with repeats."""
    none = F.array().cast("array<string>")
    tagged = lambda kind, x: F.transform(F.coalesce(x, none), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("token")))
    named = F.array_compact(F.array("imsi", F.when(fields.is_imsi("supi"), F.col("supi"))))
    every = F.concat(tagged("subscriber", F.filter(named, lambda x: fields.is_imsi(x))), tagged("tunnel", F.col("teids")), tagged("ip", F.array_union(F.array_compact(F.array("framed_ip")), F.coalesce("subscriber_ips", none))), tagged("access", F.col("access_ids")))
    return messages.select(*keys, F.explode(every).alias("t")).select(*keys, "t.kind", "t.token").where("token is not null and token != ''")


def tunnel_chains(messages: DataFrame, keys: list[str], gap: float = 15.0) -> DataFrame:
    """(keys): sessions in which bearer messages of one part go on in the next part (cut at gaps) with other tunnels: both parts name one subscriber and have tunnels,
    of which none is shared, and they share an address or access id, or one of them shows mobility.

    That a token occurred in the part before is told by a window over the token's own parts, so no part's tokens are gathered in a list."""
    parts = gap_segments(messages.where("protocol = 'GTP'"), keys, gap)
    by = [*keys, "segment"]
    seen = _tokens(parts, by).distinct()
    again = F.coalesce(F.lag("segment").over(Window.partitionBy(*keys, "kind", "token").orderBy("segment")) == F.col("segment") - 1, F.lit(False))
    marked = seen.withColumn("again", again).groupBy(*by).agg(*[F.bool_or((F.col("kind") == k) & F.col("again")).alias(f"same_{k}") for k in ("subscriber", "tunnel", "ip", "access")], F.bool_or(F.col("kind") == "tunnel").alias("tunnels"))
    moved = parts.groupBy(*by).agg(F.coalesce(F.bool_or(F.upper("message").rlike("|".join(MOBILITY))), F.lit(False)).alias("mobility"))
    order = Window.partitionBy(*keys).orderBy("segment")
    both = moved.join(marked, by, "left").withColumns({"tunnels_before": F.lag("tunnels").over(order), "mobility_before": F.lag("mobility").over(order)})
    goes_on = F.col("tunnels") & F.col("tunnels_before") & F.col("same_subscriber") & ~F.col("same_tunnel") & (F.col("same_ip") | F.col("same_access") | F.col("mobility") | F.col("mobility_before"))
    return both.where(goes_on).select(*keys).distinct()


def stateful_evidence(messages: DataFrame, keys: list[str], gap: float = 15.0, shown: int = 4) -> DataFrame:
    """(keys, methods, evidence): which states hold a session together and a text for each, in one order. Sessions without any have empty lists; null identities count for nothing.

    ``access_subscriber``: it has an access id and a subscriber or an address; ``sbi_subscriber``: a service message names a subscriber; ``tunnel_chain``: see ``tunnel_chains``."""
    identity = F.coalesce("supi", "imsi", "msisdn")
    facts = messages.groupBy(*keys).agg(
        F.min(F.when(F.size("access_ids") > 0, F.array_min("access_ids"))).alias("_access"), F.count_if(F.coalesce("imsi", "supi", "msisdn", "framed_ip").isNotNull() | (F.size("subscriber_ips") > 0)).alias("_named"),
        F.count_if(F.col("sbi_service").isNotNull() & identity.isNotNull()).alias("_sbi"), first_of("sbi_service").alias("_service"), F.min(F.when(fields.is_imsi("imsi"), F.col("imsi"))).alias("_imsi"), F.min("framed_ip").alias("_ip"),
    )
    # the first tunnels by name: a window keeps no more than are shown
    tunnels = messages.where("protocol = 'GTP'").select(*keys, F.explode("teids").alias("_t")).distinct()
    w = Window.partitionBy(*keys).orderBy("_t")
    first = tunnels.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= shown).groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("_t")), ", ").alias("_tunnels"))
    rows = facts.join(first, keys, "left").join(tunnel_chains(messages, keys, gap).withColumn("_chain", F.lit(True)), keys, "left")
    tests = [
        ("access_subscriber", F.col("_access").isNotNull() & (F.col("_named") > 0), F.concat(F.lit("access id "), F.col("_access"), F.lit(" goes with the subscriber"))),
        ("sbi_subscriber", F.col("_sbi") > 0, F.concat(F.lit("subscriber named by service "), F.col("_service"))),
        ("tunnel_chain", F.coalesce("_chain", F.lit(False)), F.concat_ws("", F.lit("tunnels "), F.col("_tunnels"), F.lit(" follow each other"), F.concat(F.lit(" for IMSI "), F.col("_imsi")), F.concat(F.lit(" at "), F.col("_ip")))),
    ]
    listed = lambda i: F.array_compact(F.array(*[F.when(t[1], F.lit(t[0]) if i == 0 else t[2]) for t in tests]))
    return rows.select(*keys, listed(0).alias("methods"), listed(2).alias("evidence"))
