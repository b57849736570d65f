"""Report tables over threat reports, alerts, packets and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoutlake.functions.exprs import fixed, protocol_name, ratio0, utc_text
from scoutlake.operators.prep import anomalous, search_packets
from scoutlake.operators.threat import SEVERITIES
from scoutlake.session import stage


def totals(reports: DataFrame, kind: str = "report") -> DataFrame:
    hit = anomalous(kind)
    return reports.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_if(hit).alias("anomalies"),
        (F.lit(100.0) * ratio0(F.count_if(hit), F.count(F.lit(1)))).alias("anomaly_rate_pct"),
    )


def severity_counts(reports: DataFrame, kind: str = "report") -> DataFrame:
    """Anomalies by severity; every level is listed, with 0 where there are none."""
    flags = [F.count_if(F.col("severity") == s) for s in SEVERITIES]
    rows = [
        F.struct(F.lit(s).alias("severity"), c.alias("reports"))
        for s, c in zip(SEVERITIES, flags, strict=True)
    ]
    return (
        reports.filter(anomalous(kind)).agg(F.array(*rows).alias("v")).select(F.explode("v").alias("v")).select("v.*")
    )


def technique_counts(reports: DataFrame) -> DataFrame:
    return (
        reports.select(F.explode("mitre_mappings").alias("technique"))
        .groupBy("technique")
        .agg(F.count(F.lit(1)).alias("reports"))
    )


def scanner_summary(reports: DataFrame, shown: int = 15) -> DataFrame:
    """Per source: probes, worst score, ports, the category seen first, first ports."""
    core = reports.groupBy("src_ip").agg(
        F.count(F.lit(1)).alias("total_probes"),
        F.max("threat_score").alias("max_score"),
        F.min_by("scan_category", F.struct("start_s", "first_id")).alias("category"),
    )
    ports = (
        reports.select("src_ip", "dst_port")
        .distinct()
        .groupBy("src_ip")
        .agg(F.array_sort(F.collect_list("dst_port")).alias("ports"))
    )
    return core.join(ports, "src_ip").select(
        "*", F.size("ports").alias("port_count"), F.slice("ports", 1, shown).alias("first_ports")
    ).drop("ports")


def timeline(reports: DataFrame) -> DataFrame:
    return reports.groupBy("timestamp").agg(F.max("threat_score").alias("threat_score")).orderBy("timestamp")


def counts_by(reports: DataFrame, column: str) -> DataFrame:
    return (
        reports.groupBy(column)
        .agg(F.count(F.lit(1)).alias("reports"))
        .orderBy(F.col("reports").desc(), column)
    )


def packets_per_second(packets: DataFrame, as_of: float, seconds: int = 30) -> DataFrame:
    """Counts of the last ``seconds`` whole seconds up to ``as_of``; gaps are 0."""
    spark = packets.sparkSession
    last = int(as_of)
    recent = packets.filter(
        (F.lit(float(as_of)) - F.col("ts_s") <= seconds) & (F.col("ts_s") < last + 1)
    )
    counts = recent.groupBy(F.floor("ts_s").alias("second")).agg(F.count(F.lit(1)).alias("packets"))
    line = spark.range(last - seconds + 1, last + 1).withColumnRenamed("id", "second")
    return line.join(counts, "second", "left").withColumn("packets", F.coalesce("packets", F.lit(0)))


def newest_packets(
    packets: DataFrame, protocol: str = "all", text: str = "", n: int = 100
) -> DataFrame:
    """The newest ``n`` matches with display columns, their place among all matches and
    the number of matches."""
    matches = search_packets(packets, protocol, text)
    found = matches.agg(F.count(F.lit(1)).alias("matches"))
    newest = matches.orderBy(F.col("pkt_id").desc()).limit(n)
    # At most n rows from here on, so numbering them in one task is bounded.
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.col("pkt_id").desc())) - 1
    name = protocol_name("proto", "IP")
    millis = F.floor((F.col("ts_s") % 1) * 1000).cast("int")
    clock = F.concat(utc_text("ts_s", "HH:mm:ss"), F.lit("."), F.lpad(millis.cast("string"), 3, "0"))
    ends = F.concat(
        name, F.lit(" Flow: "), "src_ip", F.lit(":"), "src_port", F.lit(" -> "), "dst_ip", F.lit(":"), "dst_port"
    )
    flagged = F.when(F.col("proto") == 6, F.concat(ends, F.lit(" [Flags: "), "flags", F.lit("]")))
    return newest.join(F.broadcast(found)).select(
        (F.col("matches") - place).alias("index"),
        clock.alias("time"),
        "src_ip",
        "dst_ip",
        name.alias("proto"),
        "src_port",
        "dst_port",
        F.col("payload_len").alias("payload"),
        F.when(F.col("flags") == "", "N/A").otherwise(F.col("flags")).alias("tcp_flags"),
        F.coalesce(flagged, ends).alias("summary"),
        "matches",
    )


def retained(packets: DataFrame, n: int = 5000) -> DataFrame:
    return packets.orderBy(F.col("pkt_id").desc()).limit(n)


def suspicious_sources(reports: DataFrame, kind: str = "alert") -> DataFrame:
    return reports.filter(anomalous(kind)).select("src_ip").distinct().orderBy("src_ip")


def risk_label(reports: DataFrame) -> DataFrame:
    critical = F.coalesce(F.bool_or(F.col("severity") == "CRITICAL"), F.lit(False))
    high = F.coalesce(F.bool_or(F.col("severity").isin("HIGH", "MEDIUM")), F.lit(False))
    label = F.when(critical, "CRITICAL HAZARD").when(high, "HIGH RISK WARNING").otherwise("CLEAN SECURE")
    return reports.agg(label.alias("risk"))


def metric_table(metrics: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Metrics as display text, one row per model and ``keys``."""

    def percent(name: str) -> Column:
        return F.concat(fixed(F.col(name) * 100, 2), F.lit("%"))

    return metrics.select(
        *(keys or []),
        F.upper(F.replace("model", F.lit("_"), F.lit(" "))).alias("model"),
        *[percent(n).alias(n) for n in ["accuracy", "precision", "recall", "f1"]],
        F.coalesce(fixed(F.col("roc_auc"), 4), F.lit("N/A")).alias("roc_auc"),
    )


def summary_lines(reports: DataFrame, metadata: dict, model: str) -> DataFrame:
    """(line, text) of a Markdown assessment with all threat hosts, the worst first. Only
    aggregates reach the driver; the hosts' lines are numbered by range of score."""
    hits = reports.filter(anomalous("report"))
    t = totals(reports).first()
    levels = {r["severity"]: r["reports"] for r in severity_counts(reports).collect()}
    techniques = technique_counts(hits).orderBy("technique").collect()
    ordered = scanner_summary(hits).orderBy(F.col("max_score").desc(), "src_ip")
    profiles = stage(ordered.withColumn("at", F.monotonically_increasing_id()), "profiles")
    part = F.shiftright("at", 33).alias("part")
    parts = profiles.groupBy(part).count().orderBy("part").collect()  # a row per task of the sort
    hosts = sum(r["count"] for r in parts)
    lines = [
        "# Capture forensic report",
        f"**Classifier:** {model.upper()}",
        "",
        "## Capture",
        *[f"- **{k}:** `{v}`" for k, v in metadata.items()],
        "",
        "## Summary",
        f"- **Sessions:** `{t['sessions']}`",
        f"- **Anomalies:** `{t['anomalies']} ({t['anomaly_rate_pct']:.1f}%)`",
        f"- **Threat hosts:** `{hosts}`",
        *[f"- **{level}:** `{levels[level]}`" for level in SEVERITIES],
        "",
        "## ATT&CK techniques",
        *[f"- **{r['technique']}**: `{r['reports']}` sessions" for r in techniques],
        "",
        "## Hosts",
    ]
    spark = reports.sparkSession
    before, first = [], len(lines)
    for r in parts:
        before.append((r["part"], first))
        first += 5 * r["count"]

    def told(label: str, value: Column) -> Column:
        return F.concat(F.lit(f"- **{label}:** `"), F.coalesce(value.cast("string"), F.lit("None")), F.lit("`"))

    ports = F.concat(F.lit("["), F.array_join("first_ports", ", "), F.lit("]`"))
    texts = F.array(
        F.concat(F.lit("### `"), F.coalesce("src_ip", F.lit("None")), F.lit("`")),
        told("Category", F.col("category")),
        told("Anomalous flows", F.col("total_probes")),
        told("Worst score", fixed(F.col("max_score"), 1)),
        F.concat(told("Target ports", F.col("port_count")), F.lit(", first `"), ports),
    )
    offsets = F.broadcast(spark.createDataFrame(before, "part long, first long"))
    place = F.col("first") + 5 * F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    of_hosts = (
        profiles.withColumn("part", part)
        .join(offsets, "part")
        .select(place.alias("first"), F.posexplode(texts).alias("k", "text"))
        .select((F.col("first") + F.col("k")).alias("line"), "text")
    )
    return spark.createDataFrame(list(enumerate(lines)), "line long, text string").unionByName(of_hosts)


def summary_document(reports: DataFrame, metadata: dict, model: str) -> str:
    """``summary_lines`` as one text on the driver, for captures whose hosts fit there."""
    lines = summary_lines(reports, metadata, model).orderBy("line").collect()
    return "\n".join(r["text"] for r in lines) + "\n"
