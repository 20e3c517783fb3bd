"""The canonical message schema; every operator takes and returns DataFrames in it or in tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGE_DDL = (
    "capture_id string, message_uid long, frame_number long, ts double, protocol string, technology string, transport string, src_ip string, dst_ip string, src_port int, dst_port int, "
    "stream_id string, transaction_id string, message string, method string, status_code string, result_code string, command_code string, command_name string, cause_code string, procedure string, "
    "is_failure boolean, retransmission boolean, reset boolean, timeout boolean, icmp_type string, icmp_code string, call_id string, to_tag string, dia_session_id string, tcap_tid string, "
    "imsi string, msisdn string, supi string, gpsi string, apn string, framed_ip string, teids array<string>, subscriber_ips array<string>, f_teid string, gtp_tid string, seid string, access_ids array<string>, ike_inner_ips array<string>, "
    "sbi_service string, from_uri string, to_uri string, reason string, is_auth_failure boolean, is_roaming_failure boolean, is_charging_failure boolean, is_policy_reject boolean, is_subscriber_absent boolean"
)
MESSAGE = dict(f.split(" ") for f in MESSAGE_DDL.split(", "))


def conform(df: DataFrame) -> DataFrame:
    """Adds what is missing of the message schema as typed nulls, casts the rest, and names each message by a hash of its identity."""
    have = set(df.columns)
    out = df.select(*[(F.col(name) if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in MESSAGE.items()], *[c for c in df.columns if c not in MESSAGE])
    return out.withColumn("message_uid", F.coalesce("message_uid", F.xxhash64(*identity_columns())))


def identity_columns() -> list:
    """With a frame number a message is known by five fields, else by nine."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    short = [text(c) for c in ("capture_id", "protocol", "frame_number", "message", "transaction_id")]
    long = [F.when(F.col("frame_number").isNull(), text(c)).otherwise("") for c in ("ts", "src_ip", "dst_ip", "src_port", "dst_port", "call_id", "dia_session_id")]
    return short + long
