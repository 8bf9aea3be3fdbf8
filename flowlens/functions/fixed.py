"""Fixed values that must equal the reference's for results to match.

Everything below is data (names, words, thresholds, texts); the logic using it lives in
the operator modules.
"""

# --- fixed values: the 70 flow feature names, in contract order -------------------------
FLOW_FEATURES = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean",
    "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean",
    "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean",
    "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Fwd URG Flags",
    "Fwd Header Length", "Bwd Header Length", "Fwd Packets/s", "Bwd Packets/s",
    "Min Packet Length", "Max Packet Length", "Packet Length Mean", "Packet Length Std",
    "Packet Length Variance", "FIN Flag Count", "SYN Flag Count", "RST Flag Count",
    "PSH Flag Count", "ACK Flag Count", "URG Flag Count", "CWE Flag Count", "ECE Flag Count",
    "Down/Up Ratio", "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Header Length.1", "Subflow Fwd Packets", "Subflow Fwd Bytes", "Subflow Bwd Packets",
    "Subflow Bwd Bytes", "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "act_data_pkt_fwd", "min_seg_size_forward", "Active Mean", "Active Std",
    "Active Max", "Active Min", "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]

# --- fixed values: the 11 live-stream feature names ----------------------------------
STREAM_FEATURES = [
    "flow_duration", "tot_fwd_pkts", "tot_bwd_pkts", "totlen_fwd_pkts", "totlen_bwd_pkts",
    "fwd_pkt_len_mean", "bwd_pkt_len_mean", "flow_byts_s", "flow_pkts_s",
    "init_win_byts_fwd", "init_win_byts_bwd",
]

# --- fixed values: attack-type codes and display names --------------------------------
ATTACK_TYPES = [
    ("benign", "Benign Traffic"),
    ("dos", "Denial of Service (DoS)"),
    ("probe", "Probing/Scanning"),
    ("web", "Web Attack"),
]
UNKNOWN_ATTACK = "Unknown"
NOT_ATTACK = "N/A"

# --- fixed values: attack-type cascade thresholds ------------------------------------
BENIGN_THRESHOLD = 0.5
PROBE_BELOW = 0.6
DOS_BELOW = 0.8

# --- fixed values: characteristics text per attack display name -----------------------
CHARACTERISTICS = [
    ("Denial of Service (DoS)",
     "Typically involves overwhelming network resources, high packet rates, and abnormal traffic patterns."),
    ("Probing/Scanning",
     "Often involves scanning ports or hosts, usually low volume traffic, potentially a precursor to larger attacks."),
    ("Web Attack",
     "Attempts to gain unauthorized local access from a remote machine, often exploiting vulnerabilities in network services."),
]
CHARACTERISTICS_DEFAULT = "Specific characteristics depend on the attack subtype."

# --- fixed values: recommendations ----------------------------------------------------
ATTACK_RECOMMENDATIONS = [
    "Investigate the source and destination of this traffic.",
    "Consider blocking the source IP address temporarily or permanently based on investigation.",
    "Check system logs for any signs of successful exploitation.",
    "Update firewall rules or Intrusion Detection/Prevention System (IDPS) signatures to detect similar patterns.",
    "Enhance monitoring for the affected systems or network segments.",
]
BENIGN_RECOMMENDATIONS = ["Continue routine monitoring of network traffic."]

# --- fixed values: interpretation sentence --------------------------------------------
INTERPRETATION = ("The traffic has been classified as {verdict} and identified as a {attack} "
                  "attack by the {model} model.")

# --- fixed values: label regrouping ----------------------------------------------------
WEB_ATTACK_SUBSTRING = "Web Attack"
WEB_ATTACK_GROUP = "Web_Attacks"
LABEL_GROUPS = {
    "DDoS": "DoS_Attacks",
    "DoS GoldenEye": "DoS_Attacks",
    "DoS Hulk": "DoS_Attacks",
    "DoS Slowhttptest": "DoS_Attacks",
    "DoS slowloris": "DoS_Attacks",
    "FTP-Patator": "Patator_Attacks",
    "SSH-Patator": "Patator_Attacks",
}
EXCLUDED_CLASSES = ["Patator_Attacks", "Bot", "Heartbleed", "Infiltration"]
CLASS_CODES = ["BENIGN", "DoS_Attacks", "PortScan", "Web_Attacks"]
FIXED_CLASS_WEIGHTS = {0: 0.64, 1: 0.18, 2: 0.12, 3: 0.06}

# --- fixed values: class profile ranges (class, feature, low, high) -------------------
CLASS_PROFILE = [
    ("Benign", [("Flow Duration", 1, 10), ("Total Fwd Packets", 2, 20),
                ("Total Backward Packets", 2, 20), ("Total Length of Fwd Packets", 500, 5000),
                ("Total Length of Bwd Packets", 500, 5000), ("Fwd Packet Length Mean", 50, 500),
                ("Bwd Packet Length Mean", 50, 500), ("Init_Win_bytes_forward", 8192, 65535),
                ("Init_Win_bytes_backward", 1024, 65535)]),
    ("DoS", [("Flow Duration", 0.01, 1), ("Total Fwd Packets", 10, 500),
             ("Total Backward Packets", 0, 10), ("Total Length of Fwd Packets", 1000, 50000),
             ("Total Length of Bwd Packets", 0, 1000), ("Fwd Packet Length Mean", 100, 1000),
             ("Bwd Packet Length Mean", 0, 200), ("Init_Win_bytes_forward", 0, 1024),
             ("Init_Win_bytes_backward", 0, 256)]),
    ("Probe", [("Flow Duration", 0.5, 5), ("Total Fwd Packets", 1, 5),
               ("Total Backward Packets", 0, 3), ("Total Length of Fwd Packets", 0, 500),
               ("Total Length of Bwd Packets", 0, 500), ("Fwd Packet Length Mean", 0, 100),
               ("Bwd Packet Length Mean", 0, 100), ("Init_Win_bytes_forward", 1024, 65535),
               ("Init_Win_bytes_backward", 0, 1024)]),
    ("Web", [("Flow Duration", 0.1, 5), ("Total Fwd Packets", 3, 20),
             ("Total Backward Packets", 3, 20), ("Total Length of Fwd Packets", 200, 5000),
             ("Total Length of Bwd Packets", 200, 10000), ("Fwd Packet Length Mean", 50, 300),
             ("Bwd Packet Length Mean", 50, 500), ("Init_Win_bytes_forward", 1024, 65535),
             ("Init_Win_bytes_backward", 256, 65535)]),
]

# --- fixed values: default-by-name rules (first match wins) ---------------------------
DEFAULT_RULES = [
    (("Flag", "Count"), 0.0),
    (("Mean", "Std", "Variance"), 10.0),
    (("Max",), 1000.0),
    (("Min",), 0.0),
    (("Length", "Bytes"), 1000.0),
    (("/s", "Rate"), 100.0),
]
DEFAULT_FALLBACK = 0.0

# --- fixed values: name patterns for temporal / id-like column flags ------------------
TEMPORAL_WORDS = ["time", "timestamp", "date", "hour", "minute", "second"]
ID_WORDS = ["id", "index", "key", "number", "num"]

# --- fixed values: profiling thresholds ------------------------------------------------
HIGH_CARDINALITY_RATIO = 0.9
DOMINANT_SHARE = 0.999
REDUNDANT_CORR = 0.95
INTERACTION_CORR = 0.8
VARIANCE_MIN = 0.01
EXTREME_ABS = 1e6
MI_MIN = 0.01
IMPORTANCE_MIN = 0.01
RATIO_EPS = 1e-6

# --- fixed values: model registry names (selection order) -----------------------------
MODEL_NAMES = ["GBM", "LightGBM", "XGBoost", "Random Forest", "CatBoost"]
