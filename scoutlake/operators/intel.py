"""Reputation enrichment of addresses from a supplied table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.functions.exprs import filled, private_ip

# Reputation classes and the texts of records without a feed.
CRITICAL = "CRITICAL BLACKLISTED ATTACKER"
SUSPICIOUS = "SUSPICIOUS HOST SCANNER"
CLEAN = "CLEAN ENTITY"
# column -> (blank query, private address)
FIXED_TEXT = {
    "isp": ("N/A", "Internal LAN Scope"),
    "country": ("N/A", "Local Intranet"),
    "blacklist_status": ("CLEAN", "SECURE"),
    "enrichment_source": ("N/A", "RFC 1918 Address Lookup"),
    "details": (
        "Invalid target query.",
        "Local private network address. Excluded from global blacklisting lookup.",
    ),
}
RESOLVED = (
    "Live aggregated intelligence resolved: Abuse Confidence {abuse}%. "
    "VirusTotal flag count: {positives} positive hits."
)


def blacklist_status(abuse: Column, positives: Column) -> Column:
    return (
        F.when((abuse > 75) | (positives >= 4), CRITICAL)
        .when((abuse > 35) | (positives >= 1), SUSPICIOUS)
        .otherwise(CLEAN)
    )


def enrich(addresses: DataFrame, reputation: DataFrame, ip: str = "ip") -> DataFrame:
    """One intel record per distinct address.

    Private addresses get the internal record, blank or 'any' the empty record, listed
    ones their record and class; unlisted public addresses count as clean and unknown.
    """
    one = addresses.select(F.col(ip).alias("ip")).distinct()
    # Of several records of an address, the one with the worst scores, then by its other fields.
    rest = [c for c in reputation.columns if c not in ("ip", "abuse_score", "vt_positives")]
    worst = F.max(F.struct("abuse_score", "vt_positives", *rest)).alias("worst")
    known = reputation.groupBy("ip").agg(worst).select("ip", "worst.*")
    joined = one.join(known, "ip", "left")
    blank = F.col("ip").isNull() | F.col("ip").isin("", "any")
    private = ~blank & private_ip("ip")

    def pick(if_blank, if_private, otherwise) -> Column:
        return F.when(blank, if_blank).when(private, if_private).otherwise(otherwise)

    def text(name: str, otherwise: Column) -> Column:
        return pick(*FIXED_TEXT[name], otherwise).alias(name)

    abuse = F.coalesce("abuse_score", F.lit(0))
    positives = F.coalesce("vt_positives", F.lit(0))
    no_ports = F.array().cast("array<int>")
    return joined.select(
        "ip",
        F.coalesce(private, F.lit(False)).alias("is_private"),
        pick(0, 0, abuse).alias("abuse_score"),
        pick(0, 0, positives).alias("vt_positives"),
        pick(no_ports, no_ports, F.coalesce("shodan_ports", no_ports)).alias("shodan_ports"),
        text("isp", F.coalesce("isp", F.lit("Unknown ISP"))),
        text("country", F.coalesce("country", F.lit("Unknown Location"))),
        text("blacklist_status", blacklist_status(abuse, positives)),
        text("enrichment_source", F.coalesce("enrichment_source", F.lit("Unlisted"))),
        text("details", filled(RESOLVED, abuse=abuse, positives=positives)),
    )


def attach_intel(rows: DataFrame, reputation: DataFrame, ip: str) -> DataFrame:
    """``rows`` with an ``intel`` struct for their address column.

    The lookup runs once per distinct address; joining back is an equi-join AQE can
    split when one address is hot.
    """
    records = enrich(rows, reputation, ip)
    packed = records.select(F.col("ip").alias("_ip"), F.struct(*records.columns).alias("intel"))
    # A null address has its blank record too.
    return rows.join(packed, rows[ip].eqNullSafe(packed["_ip"]), "left").drop("_ip")
