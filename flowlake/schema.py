"""Record layouts and the fixed vocabularies shared by every job.

The lists and maps in this file are fixed values: results are only right when they
equal the published data-set vocabularies, so they are written out as plain text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --------------------------------------------------------------------------- fixed values

# Canonical column order of a merged flow table: 77 features, the label, two tags.
CANONICAL_COLUMNS = [
    "Destination Port", "Flow Duration",
    "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Fwd Packet Length Max", "Fwd Packet Length Min",
    "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min",
    "Bwd Packet Length Mean", "Bwd Packet Length Std",
    "Flow Bytes/s", "Flow Packets/s",
    "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min",
    "Fwd IAT Total", "Fwd IAT Mean", "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min",
    "Bwd IAT Total", "Bwd IAT Mean", "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length",
    "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length",
    "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count",
    "PSH Flag Count", "ACK Flag Count", "URG Flag Count",
    "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size",
    "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Subflow Fwd Packets", "Subflow Fwd Bytes",
    "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
    "Label", "Source_File", "Dataset",
]

# Counters kept as 64-bit integers; every other feature is a 32-bit float.
INTEGER_FEATURES = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Fwd PSH Flags", "Bwd PSH Flags", "Fwd URG Flags", "Bwd URG Flags",
    "Fwd Header Length", "Bwd Header Length",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets", "Subflow Bwd Bytes",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "act_data_pkt_fwd", "min_seg_size_forward",
]

# Short column names of the 2018 dialect and their canonical spelling.
RENAME_2018 = {
    "Dst Port": "Destination Port",
    "Tot Fwd Pkts": "Total Fwd Packets",
    "Tot Bwd Pkts": "Total Backward Packets",
    "TotLen Fwd Pkts": "Total Length of Fwd Packets",
    "TotLen Bwd Pkts": "Total Length of Bwd Packets",
    "Fwd Pkt Len Max": "Fwd Packet Length Max",
    "Fwd Pkt Len Min": "Fwd Packet Length Min",
    "Fwd Pkt Len Mean": "Fwd Packet Length Mean",
    "Fwd Pkt Len Std": "Fwd Packet Length Std",
    "Bwd Pkt Len Max": "Bwd Packet Length Max",
    "Bwd Pkt Len Min": "Bwd Packet Length Min",
    "Bwd Pkt Len Mean": "Bwd Packet Length Mean",
    "Bwd Pkt Len Std": "Bwd Packet Length Std",
    "Flow Byts/s": "Flow Bytes/s",
    "Flow Pkts/s": "Flow Packets/s",
    "Fwd IAT Tot": "Fwd IAT Total",
    "Bwd IAT Tot": "Bwd IAT Total",
    "Fwd Header Len": "Fwd Header Length",
    "Bwd Header Len": "Bwd Header Length",
    "Fwd Pkts/s": "Fwd Packets/s",
    "Bwd Pkts/s": "Bwd Packets/s",
    "Pkt Len Min": "Min Packet Length",
    "Pkt Len Max": "Max Packet Length",
    "Pkt Len Mean": "Packet Length Mean",
    "Pkt Len Std": "Packet Length Std",
    "Pkt Len Var": "Packet Length Variance",
    "FIN Flag Cnt": "FIN Flag Count",
    "SYN Flag Cnt": "SYN Flag Count",
    "RST Flag Cnt": "RST Flag Count",
    "PSH Flag Cnt": "PSH Flag Count",
    "ACK Flag Cnt": "ACK Flag Count",
    "URG Flag Cnt": "URG Flag Count",
    "ECE Flag Cnt": "ECE Flag Count",
    "Pkt Size Avg": "Average Packet Size",
    "Fwd Seg Size Avg": "Avg Fwd Segment Size",
    "Bwd Seg Size Avg": "Avg Bwd Segment Size",
    "Fwd Byts/b Avg": "Fwd Avg Bytes/Bulk",
    "Fwd Pkts/b Avg": "Fwd Avg Packets/Bulk",
    "Fwd Blk Rate Avg": "Fwd Avg Bulk Rate",
    "Bwd Byts/b Avg": "Bwd Avg Bytes/Bulk",
    "Bwd Pkts/b Avg": "Bwd Avg Packets/Bulk",
    "Bwd Blk Rate Avg": "Bwd Avg Bulk Rate",
    "Subflow Fwd Pkts": "Subflow Fwd Packets",
    "Subflow Fwd Byts": "Subflow Fwd Bytes",
    "Subflow Bwd Pkts": "Subflow Bwd Packets",
    "Subflow Bwd Byts": "Subflow Bwd Bytes",
    "Init Fwd Win Byts": "Init_Win_bytes_forward",
    "Init Bwd Win Byts": "Init_Win_bytes_backward",
    "Fwd Act Data Pkts": "act_data_pkt_fwd",
    "Fwd Seg Size Min": "min_seg_size_forward",
}

# Columns without a counterpart in the other dialect.
DROPPED_2018 = ["Protocol", "Timestamp", "Flow ID", "Src IP", "Src Port", "Dst IP"]
DROPPED_2017 = ["Fwd Header Length.1"]

# Header name that marks the 2018 dialect.
MARKER_2018 = "Dst Port"

# Identifier columns removed before cleaning, and before scoring.
IDENTIFIERS = ["Flow ID", "Src IP", "Dst IP", "Timestamp", "Src Port", "Protocol"]
SCORING_IDENTIFIERS = ["Flow ID", "Src IP", "Dst IP", "Timestamp"]
SCORING_LABELS = ["Label", "Source_File", "Attack Type"]

METADATA = ["Label", "Source_File", "Dataset", "Attack Type"]

# Raw label spelling -> attack group.  The web-attack dash exists in four encodings.
LABEL_GROUPS = {
    "BENIGN": "Normal Traffic",
    "DoS Hulk": "DoS",
    "DoS GoldenEye": "DoS",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "DDoS": "DDoS",
    "PortScan": "Port Scanning",
    "FTP-Patator": "Brute Force",
    "SSH-Patator": "Brute Force",
    "Bot": "Bot",
    "Web Attack \xef\xbf\xbd Brute Force": "Web Attacks",
    "Web Attack \xef\xbf\xbd XSS": "Web Attacks",
    "Web Attack \xef\xbf\xbd Sql Injection": "Web Attacks",
    "Web Attack \x96 Brute Force": "Web Attacks",
    "Web Attack \x96 XSS": "Web Attacks",
    "Web Attack \x96 Sql Injection": "Web Attacks",
    "Web Attack - Brute Force": "Web Attacks",
    "Web Attack - XSS": "Web Attacks",
    "Web Attack - Sql Injection": "Web Attacks",
    "Web Attack � Brute Force": "Web Attacks",
    "Web Attack � XSS": "Web Attacks",
    "Web Attack � Sql Injection": "Web Attacks",
    "Infiltration": "Infiltration",
    "Heartbleed": "Heartbleed",
    "Benign": "Normal Traffic",
    "DoS attacks-Hulk": "DoS",
    "DoS attacks-SlowHTTPTest": "DoS",
    "DoS attacks-GoldenEye": "DoS",
    "DoS attacks-Slowloris": "DoS",
    "DDoS attacks-LOIC-HTTP": "DDoS",
    "DDOS attack-HOIC": "DDoS",
    "DDOS attack-LOIC-UDP": "DDoS",
    "FTP-BruteForce": "Brute Force",
    "SSH-Bruteforce": "Brute Force",
    "Brute Force -Web": "Web Attacks",
    "Brute Force -XSS": "Web Attacks",
    "SQL Injection": "Web Attacks",
    "Infilteration": "Infiltration",
}
UNKNOWN_GROUP = "Unknown"
BENIGN_GROUP = "Normal Traffic"
ALWAYS_RARE = ["Infiltration", "Heartbleed"]

# The 40 ordered features of an assembled flow.
FLOW_FEATURES = [
    "Destination Port",
    "Flow Duration",
    "Total Fwd Packets",
    "Total Length of Fwd Packets",
    "Fwd Packet Length Max",
    "Fwd Packet Length Min",
    "Fwd Packet Length Mean",
    "Bwd Packet Length Max",
    "Bwd Packet Length Min",
    "Flow Bytes/s",
    "Flow Packets/s",
    "Flow IAT Mean",
    "Flow IAT Std",
    "Flow IAT Max",
    "Flow IAT Min",
    "Fwd IAT Mean",
    "Fwd IAT Std",
    "Fwd IAT Min",
    "Bwd IAT Total",
    "Bwd IAT Mean",
    "Bwd IAT Std",
    "Bwd IAT Max",
    "Bwd IAT Min",
    "Fwd Header Length",
    "Bwd Header Length",
    "Bwd Packets/s",
    "Min Packet Length",
    "Max Packet Length",
    "Packet Length Mean",
    "Packet Length Variance",
    "FIN Flag Count",
    "PSH Flag Count",
    "ACK Flag Count",
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "act_data_pkt_fwd",
    "min_seg_size_forward",
    "Active Mean",
    "Active Max",
    "Active Min",
]

# How each feature relates to a packet capture: V measured, A approximated, S synthesised.
APPROXIMATED = ["Min Packet Length", "Max Packet Length"]
SYNTHESISED = [
    "Fwd Header Length", "Bwd Header Length", "Packet Length Variance", "FIN Flag Count",
    "Init_Win_bytes_forward", "Init_Win_bytes_backward", "act_data_pkt_fwd",
    "min_seg_size_forward", "Active Mean", "Active Max", "Active Min",
]

IRRELEVANT_FEATURES = [
    "ECE Flag Count",
    "RST Flag Count",
    "Fwd URG Flags",
    "Idle Std",
    "Fwd PSH Flags",
    "Active Std",
    "Down/Up Ratio",
    "URG Flag Count",
]

ENVIRONMENT_FEATURES = [
    "Init_Win_bytes_forward",
    "Init_Win_bytes_backward",
    "min_seg_size_forward",
    "Fwd Header Length",
    "Bwd Header Length",
]

PORT_FEATURE = "Destination Port"

# ------------------------------------------------------------------------ derived layouts

FEATURES = [c for c in CANONICAL_COLUMNS if c not in METADATA]

#: Position of a row inside its source file (LONG, unique and increasing per file).
ROW_ORD = "row_ord"


def feature_type(name: str) -> T.DataType:
    return T.LongType() if name in INTEGER_FEATURES else T.FloatType()


def canonical_type(name: str) -> T.DataType:
    return T.StringType() if name in METADATA else feature_type(name)


CLEAN_SCHEMA = T.StructType(
    [T.StructField(c, canonical_type(c)) for c in CANONICAL_COLUMNS]
    + [T.StructField("Attack Type", T.StringType())]
)

PACKETS = T.StructType([
    T.StructField("pkt_ord", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("us", T.LongType()),
    T.StructField("ip_version", T.IntegerType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("dst_ip", T.StringType()),
    T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("ip_len", T.IntegerType()),
    T.StructField("ip_ihl", T.IntegerType()),
    T.StructField("tcp_dataofs", T.IntegerType()),
    T.StructField("tcp_window", T.IntegerType()),
    T.StructField("tcp_flags", T.IntegerType()),
    T.StructField("udp_len", T.IntegerType()),
])


def label_map(spark: SparkSession) -> DataFrame:
    """Dimension ``(raw_label, attack_type)``."""
    return spark.createDataFrame(pa.table({
        "raw_label": list(LABEL_GROUPS), "attack_type": list(LABEL_GROUPS.values()),
    }))


def column_dialect(spark: SparkSession) -> DataFrame:
    """Dimension ``(dialect, source_name, canonical_name, action)``."""
    rows = [("2018", s, c, "rename") for s, c in RENAME_2018.items()]
    rows += [("2018", s, None, "drop") for s in DROPPED_2018]
    rows += [("2017", s, None, "drop") for s in DROPPED_2017]
    return spark.createDataFrame(
        rows, "dialect string, source_name string, canonical_name string, action string")


def feature_catalog(spark: SparkSession) -> DataFrame:
    """Dimension ``(name, ordinal, status, irrelevant, env)`` over the flow features."""
    def status(name: str) -> str:
        return "A" if name in APPROXIMATED else "S" if name in SYNTHESISED else "V"

    return spark.createDataFrame(
        [(f, i, status(f), f in IRRELEVANT_FEATURES, f in ENVIRONMENT_FEATURES)
         for i, f in enumerate(FLOW_FEATURES)],
        "name string, ordinal int, status string, irrelevant boolean, env boolean")
