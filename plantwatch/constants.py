"""Parameters whose defaults users rely on; every function takes them as arguments."""

# --- Fixed values: thresholds and window sizes --------------------------------
PRIMARY_THRESHOLD = 0.77
EARLY_WARNING_THRESHOLD = 0.07
ATTACK_THRESHOLD = 0.50
HIGH_RISK_THRESHOLD = 0.80
CONFIRM_WINDOW = 3
CONFIRM_COUNT = 2
TICK_MINUTES = 2
MAX_EXPLAINED_FLOWS = 24
MAX_EXPLAINED_ROWS = 800
NEAR_CONSTANT_SHARE = 0.995
ID_LIKE_RATIO = 0.90
HIGH_CARDINALITY_RATIO = 0.05
HIGH_CARDINALITY_COUNT = 100
MIN_PRECISION = 0.30
MIN_F1 = 0.50
WILSON_Z = 1.96
SAMPLES_PER_CLASS = 40
HISTOGRAM_BINS = 30
BOOTSTRAP_RESAMPLES = 5000
SEED = 42

# --- Fixed values: names of levels and states, ascending severity -------------
LEVELS = ["OK", "WARNING", "NETWORK ALERT", "ALARM", "CRITICAL"]

# --- Fixed values: accepted input ranges (inclusive) --------------------------
MACHINE_TYPES = ["L", "M", "H"]
MACHINE_BOUNDS = {
    "Air temperature": (270.0, 330.0),
    "Process temperature": (280.0, 340.0),
    "Rotational speed": (500.0, 3000.0),
    "Torque": (0.0, 100.0),
    "Tool wear": (0.0, 300.0),
}
FLOW_ABS_LIMIT = 1e12

# --- Fixed values: class lists ------------------------------------------------
NORMAL_CLASSES = ["MQTT_Publish", "Thing_Speak", "Wipro_bulb"]
ATTACK_FAMILIES = {
    "ARP_poisioning": ["ARP_poisioning"],
    "NMAP_scans": [
        "NMAP_UDP_SCAN", "NMAP_XMAS_TREE_SCAN", "NMAP_OS_DETECTION",
        "NMAP_TCP_scan", "NMAP_FIN_SCAN",
    ],
    "DDOS_Slowloris": ["DDOS_Slowloris"],
    "Metasploit_SSH": ["Metasploit_Brute_Force_SSH"],
    "DOS_SYN_Hping": ["DOS_SYN_Hping"],
}
FAILURE_MODES = {
    "TWF": "tool wear failure",
    "HDF": "heat dissipation failure",
    "PWF": "power failure",
    "OSF": "overstrain failure",
    "RNF": "random failure",
}

# --- Fixed values: cut points of a Poisson(1) weight on the first 8 hex digits
#     of an md5, for weights 0, 1, 2, 3, 4 (5 beyond the last one) -------------
POISSON_HEX_CUTS = ["5e2d58d8", "bc5ab1b1", "eb715e1d", "fb23ed97", "ff108d75"]
