"""Queries: schema mapping, predicates, audit, splits, enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoutlake.catalog.registry import query, rounded, table
from scoutlake.catalog.sql import CTES, r6
from scoutlake.functions import exprs as ex
from scoutlake.operators import audit as au
from scoutlake.operators import intel as it
from scoutlake.operators import prep as pr
from scoutlake.operators import splits as sp
from scoutlake.plans.analysis import reports
from scoutlake.plans.features import features, labelled_features
from scoutlake.schemas import FEATURES_20, HOST_FEATURES
from scoutlake.session import stage
from scoutlake.sources.events_view import read_packets

# External-looking flow tables derived from `orders`, in both dialects.
CIC_RAW = """SELECT o_orderkey AS row_id,
  CASE WHEN o_custkey % 97 = 0 THEN 'bad' ELSE CAST(o_custkey * 1000 + o_orderkey % 1000 AS {text}) END AS {q} Flow Duration{q},
  o_orderkey % 5 AS {q}Total Fwd Packets{q}, o_custkey % 4 AS {q} Total Backward Packets{q},
  o_orderkey % 1500 AS {q}Total Length of Fwd Packets{q}, o_custkey % 900 AS {q}Total Length of Bwd Packets{q},
  o_orderkey % 2 AS {q}SYN Flag Count{q}, o_custkey % 3 AS {q}ACK Flag Count{q},
  CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderkey % 3 END AS {q}RST Flag Count{q}, o_custkey % 2 AS {q}FIN Flag Count{q},
  CASE WHEN o_orderkey % 11 = 0 THEN 'Infinity' WHEN o_orderkey % 13 = 0 THEN 'NaN' WHEN o_orderkey % 17 = 0 THEN ''
       ELSE CAST(o_custkey % 777 AS {text}) END AS {q}Packet Length Mean{q},
  o_totalprice AS {q}Packet Length Variance{q}, o_totalprice / 10 AS {q}Flow IAT Mean{q},
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice / 100 END AS {q}Flow IAT Std{q},
  CASE WHEN o_orderstatus = 'F' THEN ' BENIGN' ELSE 'PortScan ' END AS {q} Label{q}
FROM orders"""
UNSW_RAW = """SELECT o_orderkey AS row_id,
  CASE WHEN o_custkey % 97 = 0 THEN '-' ELSE CAST(o_custkey % 60 AS {text}) END AS dur,
  CAST(o_orderkey % 5 AS {text}) AS spkts, CAST(o_custkey % 4 AS {text}) AS dpkts,
  CAST(o_orderkey % 1500 AS {text}) AS sbytes, CAST(o_custkey % 900 AS {text}) AS dbytes,
  CASE o_orderkey % 6 WHEN 0 THEN ' syn' WHEN 1 THEN 'S0' WHEN 2 THEN 'rstr' WHEN 3 THEN 'FIN' WHEN 4 THEN NULL ELSE 'CON' END AS state,
  CAST(o_custkey % 31 AS {text}) AS sintpkt, CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE CAST(o_custkey % 17 AS {text}) END AS dintpkt,
  CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN ' Reconnaissance ' WHEN o_orderpriority = '1-URGENT' THEN 'Fuzzers' END AS attack_cat,
  CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS {text}) AS label
FROM orders"""
TON_RAW = """SELECT o_orderkey AS row_id, o_custkey * 10 AS FLOW_DURATION_MILLISECONDS,
  o_orderkey % 5 AS IN_PKTS, o_custkey % 4 AS OUT_PKTS, o_orderkey % 1500 AS IN_BYTES, o_custkey % 900 AS OUT_BYTES,
  CASE o_orderstatus WHEN 'F' THEN 'scanning' WHEN 'O' THEN 'Benign' ELSE 'ddos' END AS Attack
FROM orders"""
DATASET = """SELECT o_orderkey AS row_id, CAST(o_orderpriority IN ('1-URGENT', '2-HIGH') AS INT) AS label,
  CAST(o_custkey % 50 AS DOUBLE) AS f1, CAST(o_orderkey % 40 AS DOUBLE) AS f2, o_custkey % 10 AS host,
  {day} AS ts_s, o_orderstatus AS source FROM orders"""
DUCK = {"text": "VARCHAR", "q": '"', "day": "epoch(o_orderdate)"}
SPARK = {
    "text": "STRING",
    "q": "`",
    "day": "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate) AS DOUBLE)",
}
for _name, _text in [("cicraw", CIC_RAW), ("unswraw", UNSW_RAW), ("tonraw", TON_RAW), ("dset", DATASET)]:
    CTES[_name] = _text.format(**DUCK)

MIX = "(row_id * 2654435761 + 42) % 1000003"


def derived(spark, sf, text):
    return spark.sql(text.format(**SPARK).replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`"))


def mix():
    return F.expr(MIX)


def _clean(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL OR isnan({expr}) OR isinf({expr}) THEN 0.0 ELSE {expr} END"


def _num(name: str) -> str:
    return f'coalesce(TRY_CAST("{name}" AS DOUBLE), 0.0)'


CIC_PACKETS = f"({_num('Total Fwd Packets')} + {_num(' Total Backward Packets')})"
CIC_SQL = f"""SELECT {r6(
    f"flow_duration={_num(' Flow Duration')} / 1e6",
    f"flow_packet_count={CIC_PACKETS}",
    f"flow_bytes={_num('Total Length of Fwd Packets')} + {_num('Total Length of Bwd Packets')}",
    *[f"flow_{f.lower()}_ratio=coalesce({_num(f + ' Flag Count')} / nullif({CIC_PACKETS}, 0), 0.0)" for f in ["SYN", "ACK", "RST", "FIN"]],
    "flow_size_mean=" + _clean(_num("Packet Length Mean")),
    f"flow_size_var={_num('Packet Length Variance')}",
    f"flow_interval_mean={_num('Flow IAT Mean')}",
    f"flow_interval_var={_num('Flow IAT Std')} * {_num('Flow IAT Std')}",
    *[f"{h}=0.0" for h in HOST_FEATURES])},
  CAST(trim(" Label") <> 'BENIGN' AS INT) AS label, trim(" Label") AS attack_type, 'cic_ids_2017' AS dataset_source
FROM cicraw"""


@query("p3_p8_map_cic", CIC_SQL)
def p8(spark, sf):
    return rounded(pr.map_cic(derived(spark, sf, CIC_RAW)))


UNSW_PACKETS = f"({_num('spkts')} + {_num('dpkts')})"
UNSW_SQL = f"""WITH recon AS (SELECT * FROM unswraw WHERE lower(trim(attack_cat)) = 'reconnaissance'),
benign AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY {MIX}, row_id) AS rn FROM unswraw WHERE label = '0')
  WHERE rn <= 2 * (SELECT count(*) FROM recon))
SELECT {r6(
    f"flow_duration={_num('dur')}", f"flow_packet_count={UNSW_PACKETS}", f"flow_bytes={_num('sbytes')} + {_num('dbytes')}",
    "flow_syn_ratio=CASE WHEN upper(trim(state)) IN ('SYN', 'S0', 'S1') THEN 1 ELSE 0 END", "flow_ack_ratio=0.0",
    "flow_rst_ratio=CASE WHEN upper(trim(state)) IN ('RST', 'RSTO', 'RSTR', 'RSTRH') THEN 1 ELSE 0 END", "flow_fin_ratio=0.0",
    f"flow_size_mean=coalesce(({_num('sbytes')} + {_num('dbytes')}) / nullif({UNSW_PACKETS}, 0), 0.0)", "flow_size_var=0.0",
    f"flow_interval_mean=({_num('sintpkt')} + {_num('dintpkt')}) / 2", "flow_interval_var=0.0", *[f"{h}=0.0" for h in HOST_FEATURES])},
  CAST(label AS INT) AS label, coalesce(trim(attack_cat), 'benign') AS attack_type, 'unsw_nb15' AS dataset_source
FROM (SELECT * FROM recon UNION ALL SELECT * FROM benign)"""


@query("p9_x2_map_unsw", UNSW_SQL)
def p9(spark, sf):
    raw = derived(spark, sf, UNSW_RAW)
    subset = pr.unsw_subset(raw, "row_id", mix(), F.shiftright(mix(), 6))
    return rounded(pr.map_unsw(subset))


TON_PACKETS = "CAST(IN_PKTS + OUT_PKTS AS DOUBLE)"


@query(
    "p10_map_ton_iot",
    f"""SELECT {r6("flow_duration=FLOW_DURATION_MILLISECONDS / 1000.0", f"flow_packet_count={TON_PACKETS}", "flow_bytes=IN_BYTES + OUT_BYTES",
      *[f"flow_{f}_ratio=0.0" for f in ["syn", "ack", "rst", "fin"]],
      f"flow_size_mean=coalesce((IN_BYTES + OUT_BYTES) / nullif({TON_PACKETS}, 0), 0.0)", "flow_size_var=0.0",
      f"flow_interval_mean=coalesce(FLOW_DURATION_MILLISECONDS / 1000.0 / nullif({TON_PACKETS}, 0), 0.0)", "flow_interval_var=0.0",
      *[f"{h}=0.0" for h in HOST_FEATURES])}, CAST(Attack = 'scanning' AS INT) AS label, Attack AS attack_type,
      'nf_ton_iot_v2' AS dataset_source FROM tonraw WHERE Attack IN ('scanning', 'Benign')""",
)
def p10(spark, sf):
    return rounded(pr.map_ton_iot(derived(spark, sf, TON_RAW)))


@query("p1_p2_canonical_columns", f"SELECT {r6(*FEATURES_20)}, label FROM (SELECT *, CAST(syn > 0 AND ack = 0 AS INT) AS label FROM f20)")
def p1(spark, sf):
    labelled = features(read_packets(spark, sf)).withColumn(
        "label", ((F.col("syn") > 0) & (F.col("ack") == 0)).cast("int")
    )
    return rounded(pr.canonical(pr.drop_identifiers(labelled), "label"))


@query(
    "p4_p6_coercion",
    """SELECT row_id, CASE WHEN isnan(coalesce(TRY_CAST("Packet Length Mean" AS DOUBLE), 0.0)) THEN NULL
         ELSE round(coalesce(TRY_CAST("Packet Length Mean" AS DOUBLE), 0.0), 6) END AS parsed,
       round(CASE WHEN isnan(coalesce(TRY_CAST("Packet Length Mean" AS DOUBLE), 0.0)) OR isinf(coalesce(TRY_CAST("Packet Length Mean" AS DOUBLE), 0.0))
         THEN 0.0 ELSE coalesce(TRY_CAST("Packet Length Mean" AS DOUBLE), 0.0) END, 6) + 0.0 AS cleaned,
       round("Total Length of Fwd Packets" / nullif("Total Fwd Packets", 0), 6) AS per_packet
       FROM cicraw""",
)
def p4(spark, sf):
    raw = derived(spark, sf, CIC_RAW)
    parsed = ex.to_number("Packet Length Mean")
    out = raw.select(
        "row_id",
        F.when(~F.isnan(parsed), parsed).alias("parsed"),  # NaN is null here, as no comparison holds for it
        ex.finite_or_zero(parsed).alias("cleaned"),
        ex.safe_div("Total Length of Fwd Packets", "Total Fwd Packets").alias("per_packet"),
    )
    return rounded(out)


@query(
    "p7_missing_columns",
    f"""SELECT row_id, {", ".join(f"0.0::DOUBLE AS {f}" for f in FEATURES_20)}, label, 'lab' AS dataset_source, source AS attack_type FROM dset""",
)
def p7(spark, sf):
    base = derived(spark, sf, DATASET).select("row_id", "label", "source")
    return pr.with_missing(base, "lab", F.col("source")).drop("source")


@query("p11_min_packets", "SELECT flow_id, packets FROM flowname WHERE packets >= 2")
def p11(spark, sf):
    from scoutlake.operators.flows import assemble_flows, at_least

    return at_least(assemble_flows(read_packets(spark, sf)), 2).select("flow_id", "packets")


@query(
    "p12_packet_search",
    """SELECT pkt_id FROM pkt WHERE proto = 6 AND (contains(lower(src_ip), '21') OR contains(lower(dst_ip), '21')
       OR contains(CAST(src_port AS VARCHAR), '21') OR contains(CAST(dst_port AS VARCHAR), '21') OR contains(lower(flags), '21'))""",
)
def p12(spark, sf):
    return pr.search_packets(read_packets(spark, sf), "TCP", " 21 ").select("pkt_id")


@query("p13_category_match", "SELECT row_id FROM unswraw WHERE lower(trim(attack_cat)) = 'reconnaissance'")
def p13(spark, sf):
    raw = derived(spark, sf, UNSW_RAW)
    return raw.filter(pr.same_text(F.col("attack_cat"), "reconnaissance")).select("row_id")


@query(
    "p14_anomalies",
    """SELECT flow_id, prediction = 1 OR severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AS report,
       prediction = 1 OR severity IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') AS alert,
       severity IN ('CRITICAL', 'HIGH', 'MEDIUM') AS radar FROM threat""",
)
def p14(spark, sf):
    kinds = [pr.anomalous(k).alias(k) for k in pr.ANOMALY_LEVELS]
    return reports(read_packets(spark, sf)).select("flow_id", *kinds)


ADDRESS = "concat(c_custkey % 256, '.', c_nationkey * 10 % 256, '.', c_custkey % 7, '.', c_custkey % 250)"
PRIVATE_SQL = """(ip LIKE '127.%' OR ip = 'localhost' OR split_part(ip, '.', 1) = '10'
 OR (split_part(ip, '.', 1) = '172' AND CAST(split_part(ip, '.', 2) AS INT) BETWEEN 16 AND 31)
 OR (split_part(ip, '.', 1) = '192' AND split_part(ip, '.', 2) = '168') OR (split_part(ip, '.', 1) = '169' AND split_part(ip, '.', 2) = '254'))"""


@query("p15_private_addresses", f"SELECT c_custkey, ip, {PRIVATE_SQL} AS private FROM (SELECT c_custkey, {ADDRESS} AS ip FROM customer)")
def p15(spark, sf):
    rows = table(spark, sf, "customer").selectExpr("c_custkey", f"{ADDRESS} AS ip")
    return rows.withColumn("private", ex.private_ip("ip"))


@query(
    "p16_reputation_class",
    """SELECT c_custkey, CASE WHEN c_custkey % 100 > 75 OR c_nationkey % 8 >= 4 THEN 'CRITICAL BLACKLISTED ATTACKER'
       WHEN c_custkey % 100 > 35 OR c_nationkey % 8 >= 1 THEN 'SUSPICIOUS HOST SCANNER' ELSE 'CLEAN ENTITY' END AS status FROM customer""",
)
def p16(spark, sf):
    status = it.blacklist_status(F.col("c_custkey") % 100, F.col("c_nationkey") % 8)
    return table(spark, sf, "customer").select("c_custkey", status.alias("status"))


@query(
    "p17_mapping_coverage",
    """WITH kinds AS (SELECT n_name AS dataset, CASE WHEN s_suppkey % 20 < 4 THEN 'direct' WHEN s_suppkey % 20 < 10 THEN 'computed'
         WHEN s_suppkey % 20 < 11 THEN 'approximated' ELSE 'unavailable' END AS kind FROM supplier JOIN nation ON n_nationkey = s_nationkey)
       SELECT dataset, count(*) FILTER (kind = 'direct') AS direct, count(*) FILTER (kind = 'computed') AS computed,
       count(*) FILTER (kind = 'approximated') AS approximated, count(*) FILTER (kind = 'unavailable') AS unavailable FROM kinds GROUP BY dataset""",
)
def p17(spark, sf):
    kind = (
        F.when(F.col("s_suppkey") % 20 < 4, "direct")
        .when(F.col("s_suppkey") % 20 < 10, "computed")
        .when(F.col("s_suppkey") % 20 < 11, "approximated")
        .otherwise("unavailable")
    )
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("dataset"))
    rows = table(spark, sf, "supplier").join(nations, "s_nationkey").select("dataset", kind.alias("kind"))
    return pr.mapping_coverage(rows)


@query(
    "p18_ablation_columns",
    "SELECT 'Without host-level features' AS configuration, count(*) AS rows, "
    + r6("total=sum(" + " + ".join(FEATURES_20[:11]) + ")") + " FROM f20 UNION ALL "
    + "SELECT 'Without TCP-flag features', count(*), "
    + r6("total=sum(" + " + ".join(n for n in FEATURES_20 if not n.endswith(("syn_ratio", "ack_ratio", "rst_ratio", "fin_ratio"))) + ")")
    + " FROM f20",
)
def p18(spark, sf):
    feats = stage(features(read_packets(spark, sf)), "features")
    parts = [
        feats.agg(
            F.lit(c).alias("configuration"),
            F.count(F.lit(1)).alias("rows"),
            F.sum(pr.feature_total(pr.ablation_features(c))).alias("total"),
        )
        for c in ["Without host-level features", "Without TCP-flag features"]
    ]
    return rounded(parts[0].unionByName(parts[1]))


@query(
    "p19_protocol_names",
    """SELECT pkt_id, CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE CAST(proto AS VARCHAR) END AS in_alerts,
       CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'Other' END AS in_reports,
       CASE proto WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' ELSE 'IP' END AS in_packets FROM pkt""",
)
def p19(spark, sf):
    return read_packets(spark, sf).select(
        "pkt_id",
        ex.protocol_name("proto").alias("in_alerts"),
        ex.protocol_name("proto", "Other").alias("in_reports"),
        ex.protocol_name("proto", "IP").alias("in_packets"),
    )


INTEL_SQL = f"""WITH adr AS (SELECT DISTINCT ip FROM (SELECT {ADDRESS} AS ip FROM customer UNION ALL SELECT 'any' UNION ALL SELECT '')),
rep AS (SELECT DISTINCT ip, CAST(split_part(ip, '.', 4) AS INT) % 101 AS abuse, CAST(split_part(ip, '.', 3) AS INT) % 6 AS vt
  FROM (SELECT {ADDRESS} AS ip FROM customer WHERE c_custkey % 2 = 0)),
j AS (SELECT a.ip, a.ip IN ('', 'any') AS blank, CASE WHEN a.ip IN ('', 'any') THEN FALSE ELSE {PRIVATE_SQL.replace("ip", "a.ip").replace("spla.ipt", "split")} END AS private,
  coalesce(abuse, 0) AS abuse, coalesce(vt, 0) AS vt, rep.ip IS NOT NULL AS listed FROM adr a LEFT JOIN rep ON rep.ip = a.ip)
SELECT ip, private AS is_private, CASE WHEN blank OR private THEN 0 ELSE abuse END AS abuse_score,
  CASE WHEN blank OR private THEN 0 ELSE vt END AS vt_positives,
  CASE WHEN blank THEN 'CLEAN' WHEN private THEN 'SECURE' WHEN abuse > 75 OR vt >= 4 THEN 'CRITICAL BLACKLISTED ATTACKER'
    WHEN abuse > 35 OR vt >= 1 THEN 'SUSPICIOUS HOST SCANNER' ELSE 'CLEAN ENTITY' END AS blacklist_status,
  CASE WHEN blank THEN 'N/A' WHEN private THEN 'Internal LAN Scope' WHEN listed THEN 'Some ISP' ELSE 'Unknown ISP' END AS isp
FROM j"""


@query("i1_reputation", INTEL_SQL)
def i1(spark, sf):
    customers = table(spark, sf, "customer")
    listed = customers.selectExpr(f"{ADDRESS} AS ip")
    extra = listed.limit(1).select(F.explode(F.array(F.lit("any"), F.lit(""))).alias("ip"))
    known = (
        customers.filter("c_custkey % 2 = 0")
        .selectExpr(f"{ADDRESS} AS ip")
        .distinct()
        .selectExpr(
            "ip", "CAST(split(ip, '[.]')[3] AS INT) % 101 AS abuse_score",
            "CAST(split(ip, '[.]')[2] AS INT) % 6 AS vt_positives",
            "CAST(array() AS ARRAY<INT>) AS shodan_ports", "'Some ISP' AS isp",
            "'Somewhere' AS country", "'feed' AS enrichment_source",
        )
    )
    return it.enrich(listed.unionByName(extra), known).select(
        "ip", "is_private", "abuse_score", "vt_positives", "blacklist_status", "isp"
    )


@query(
    "q1_q2_audit",
    """SELECT count(*) AS rows, 10 AS columns, CAST(sum(CASE WHEN attack_cat IS NULL THEN 1 ELSE 0 END + CASE WHEN state IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_count,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM unswraw)) AS duplicate_rows FROM unswraw""",
)
def q1(spark, sf):
    return au.profile(derived(spark, sf, UNSW_RAW).drop("row_id"))


@query("q3_distribution", "SELECT CAST(state AS VARCHAR) AS value, count(*) AS rows FROM unswraw GROUP BY state")
def q3(spark, sf):
    return au.distribution(derived(spark, sf, UNSW_RAW), "state")


@query(
    "q4_coverage_flags",
    """SELECT bool_or(contains(lower(attack_cat), 'syn')) AS has_syn_scan, bool_or(contains(lower(attack_cat), 'fin')) AS has_fin_scan,
       bool_or(contains(lower(attack_cat), 'null')) AS has_null_scan, bool_or(contains(lower(attack_cat), 'xmas')) AS has_xmas_scan,
       bool_or(contains(lower(attack_cat), 'udp')) AS has_udp_scan, bool_or(contains(lower(attack_cat), 'sweep') OR contains(lower(attack_cat), 'distributed')) AS has_sweep,
       bool_or(contains(lower(attack_cat), 'portscan') OR contains(lower(attack_cat), 'port scan')) AS has_port_scan,
       bool_or(contains(lower(attack_cat), 'reconnaissance')) AS has_reconnaissance FROM unswraw""",
)
def q4(spark, sf):
    return au.coverage(derived(spark, sf, UNSW_RAW), "attack_cat", au.SCAN_WORDS)


@query("q5_category_count", "SELECT count(*) AS rows FROM unswraw WHERE lower(trim(attack_cat)) = 'reconnaissance'")
def q5(spark, sf):
    return au.category_count(derived(spark, sf, UNSW_RAW), "attack_cat", "Reconnaissance")


@query(
    "q7_preflight",
    """WITH want AS (SELECT n_name AS name, CAST(n_nationkey + 50 AS BIGINT) AS expected_rows FROM nation),
       have AS (SELECT n_name AS name, count(*) AS found_rows FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name)
       SELECT name, expected_rows, coalesce(found_rows, 0) AS found_rows, coalesce(found_rows, 0) = expected_rows AS pass FROM want LEFT JOIN have USING (name)""",
)
def q7(spark, sf):
    nation = table(spark, sf, "nation")
    names = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name"))
    found = table(spark, sf, "customer").join(names, "c_nationkey").groupBy("name").agg(F.count(F.lit(1)).alias("rows"))
    want = nation.select("n_name", (F.col("n_nationkey") + 50).alias("n"))
    return au.preflight(found, au.expectations(want, "n_name", "n"))


@query(
    "q8_duplicate_balance",
    """WITH v AS (SELECT f1, f2, count(*) AS c, count(*) FILTER (label = 1) AS r, arg_min(label, row_id) AS l FROM dset GROUP BY f1, f2)
       SELECT CAST(sum(c) AS BIGINT) AS original_rows, count(*) AS dedup_rows, round(100.0 * (sum(c) - count(*)) / sum(c), 6) AS duplicate_rate_pct,
       CAST(sum(r) AS BIGINT) AS recon_original, CAST(sum(c) - sum(r) AS BIGINT) AS benign_original,
       count(*) FILTER (l = 1) AS recon_dedup, count(*) FILTER (l = 0) AS benign_dedup FROM v""",
)
def q8(spark, sf):
    return rounded(au.duplicate_balance(derived(spark, sf, DATASET), ["f1", "f2"]))


def _ranked(quota: str, order: str = f"{MIX}, row_id", where: str = "") -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY label ORDER BY {order}) <= {quota} AS chosen
      FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n FROM dset {where}))"""


@query("x1_stratified_split", f"SELECT row_id, label, chosen AS held_out FROM {_ranked('round(n * 0.2)')}")
def x1(spark, sf):
    out = sp.stratified_split(derived(spark, sf, DATASET), "label", "row_id", 0.2, mix(), F.shiftright(mix(), 6))
    return out.select("row_id", "label", "held_out")


@query("x2_per_class_sample", f"SELECT row_id, label FROM {_ranked('500')} WHERE chosen")
def x2(spark, sf):
    out = sp.per_class_sample(derived(spark, sf, DATASET), "label", 500, "row_id", mix(), F.shiftright(mix(), 6))
    return out.select("row_id", "label")


@query(
    "x3_temporal_split",
    """SELECT row_id, CASE WHEN rn <= floor(n * 0.7) THEN 'train' WHEN rn <= floor(n * 0.7) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS subset
       FROM (SELECT row_id, row_number() OVER (ORDER BY ts_s, row_id) AS rn, count(*) OVER () AS n FROM dset)""",
)
def x3(spark, sf):
    return sp.temporal_split(derived(spark, sf, DATASET), "ts_s", "row_id", grain=86400.0).select("row_id", "subset")


@query("x4_host_split", "SELECT row_id, CASE WHEN host IN (3, 7) THEN 'test' ELSE 'train' END AS subset FROM dset")
def x4(spark, sf):
    rows = derived(spark, sf, DATASET)
    held = table(spark, sf, "nation").filter("n_nationkey IN (3, 7)").select(F.col("n_nationkey").alias("host"))
    return sp.host_split(rows, held, "host").select("row_id", "subset")


X5_SQL = f"""SELECT row_id, label, CASE WHEN rn <= round(n * 0.1) THEN 'val' ELSE 'train' END AS subset, 'cross_dataset' AS strategy
 FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {MIX}, row_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM dset WHERE source <> 'P')
 WHERE rn <= round(n * 0.1) OR rn > round(n * 0.2)
 UNION ALL SELECT row_id, label, 'test', 'cross_dataset' FROM dset WHERE source = 'P'"""


@query("x5_cross_dataset_split", X5_SQL)
def x5(spark, sf):
    rows = derived(spark, sf, DATASET)
    pool = rows.filter("source = 'F'").unionByName(rows.filter("source = 'O'"))
    out = sp.three_way(
        pool, rows.filter("source = 'P'"), "label", "row_id", "cross_dataset", 0.1, 0.1, mix(),
        F.shiftright(mix(), 6),
    )
    return out.select("row_id", "label", "subset", "strategy")


X6_SQL = f"""SELECT row_id, label, CASE WHEN chosen THEN 'val' ELSE 'train' END AS subset FROM {_ranked("round(n * 0.15)", where="WHERE source = 'F'")}
 UNION ALL SELECT row_id, label, 'test' FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {MIX}, row_id) AS rn FROM dset WHERE source = 'O')
 WHERE label = 1 OR rn <= 400"""


@query("x6_cross_corpus_split", X6_SQL)
def x6(spark, sf):
    rows = derived(spark, sf, DATASET)
    other = rows.filter("source = 'O'")
    benign = sp.per_class_sample(other.filter("label = 0"), "label", 400, "row_id", mix(), F.shiftright(mix(), 6))
    test = other.filter("label = 1").unionByName(benign)
    out = sp.three_way(
        rows.filter("source = 'F'"), test, "label", "row_id", "pcap_wise", 0.15,
        order=mix(), bucket=F.shiftright(mix(), 6),
    )
    return out.select("row_id", "label", "subset")


def _host_split(spark, sf):
    rows = derived(spark, sf, DATASET)
    held = table(spark, sf, "nation").filter("n_nationkey IN (3, 7)").select(F.col("n_nationkey").alias("host"))
    return sp.host_split(rows, held, "host").withColumn("strategy", F.lit("host_wise"))


@query(
    "x7_split_verification",
    """SELECT 'host_wise' AS strategy, CASE WHEN host IN (3, 7) THEN 'test' ELSE 'train' END AS subset,
       count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS recon FROM dset GROUP BY ALL""",
)
def x7(spark, sf):
    return sp.verify_split(_host_split(spark, sf))


@query(
    "x8_split_statistics",
    """SELECT 'host_wise' AS strategy, CASE WHEN host IN (3, 7) THEN 'test' ELSE 'train' END AS subset, count(*) AS total,
       count(*) FILTER (label = 0) AS benign, count(*) FILTER (label = 1) AS recon,
       round(count(*) FILTER (label = 1) / count(*) FILTER (label = 0), 3) AS class_balance_ratio,
       count(*) - count(DISTINCT (f1, f2)) AS duplicate_feature_rows, CAST(0 AS BIGINT) AS missing_values FROM dset GROUP BY ALL""",
)
def x8(spark, sf):
    return sp.split_statistics(_host_split(spark, sf), ["f1", "f2"])


CAPS = [1, 2, 5, 10, None]


@query(
    "x9_duplicate_cap",
    " UNION ALL ".join(
        f"SELECT '{c}' AS cap, count(*) AS rows, CAST(sum(row_id) AS BIGINT) AS id_sum FROM "
        f"(SELECT row_id, row_number() OVER (PARTITION BY f1, f2 ORDER BY row_id) AS rn FROM dset) WHERE rn <= {c or 10**9}"
        for c in CAPS
    ),
)
def x9(spark, sf):
    rows = derived(spark, sf, DATASET)
    parts = [
        sp.cap_duplicates(rows, ["f1", "f2"], "row_id", c).agg(
            F.lit(str(c)).alias("cap"), F.count(F.lit(1)).alias("rows"), F.sum("row_id").alias("id_sum")
        )
        for c in CAPS
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("x10_seeded_shuffle", f"SELECT row_id, {MIX} AS place FROM dset ORDER BY place, row_id")
def x10(spark, sf):
    return sp.shuffled(derived(spark, sf, DATASET), "row_id", order=mix()).select("row_id", mix().alias("place"))


@query("x11_random_rows", f"SELECT row_id FROM dset ORDER BY {MIX}, row_id LIMIT 500")
def x11(spark, sf):
    return sp.random_rows(derived(spark, sf, DATASET), 500, "row_id", order=mix()).select("row_id")


@query(
    "l2_labelled_balance",
    "SELECT label, count(*) AS flows FROM (SELECT CAST(((host_port_entropy > 2.0 AND host_failed_flow_ratio > 0.7 AND flow_syn_ratio > 0.5) "
    "OR (host_dst_diversity > 4 AND host_dst_entropy > 1.5 AND host_syn_ratio > 0.7) OR (flow_packet_count <= 2 AND flow_syn_ratio = 1.0 "
    "AND flow_ack_ratio = 0.0 AND host_port_entropy > 1.5)) AS INT) AS label FROM f20) GROUP BY label",
)
def l2_balance(spark, sf):
    labelled = labelled_features(read_packets(spark, sf))
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("flows"))
