"""Fixed values of the domain: categories, patterns, tables, weights, thresholds.

Everything here is data that must have these values for right results; no logic.
"""

# ---- fixed values: categories -------------------------------------------------------------

VALVE, PIPE, BEARING, CABLE, FASTENER, UNKNOWN = (
    "gate_valve",
    "pipe",
    "bearing",
    "electrical_cable",
    "fastener",
    "unknown",
)
#: In the order of entity numbering.
CATEGORIES = (VALVE, PIPE, BEARING, CABLE, FASTENER)
CATEGORY_LABELS = {
    VALVE: "Gate Valve",
    PIPE: "Pipe",
    BEARING: "Bearing",
    CABLE: "Electrical Cable",
    FASTENER: "Fastener",
    UNKNOWN: "Unknown",
}
CATEGORY_CODES = {
    VALVE: "40141607",
    PIPE: "40174300",
    BEARING: "31171500",
    CABLE: "26121600",
    FASTENER: "31161500",
}

# ---- fixed values: detection patterns, in the order in which they are tried ---------------

DETECTION = {
    VALVE: r"\bGATE\s*VALVE\b|\bGT\s*VLV\b|\bGATE\s*V/?V\b|\bVALVE\s*,?\s*GATE\b|\bGT\s*VALVE\b|\bGATE\s*VLV\b",
    BEARING: r"\bBEARING\b|\bBRG\b|\bDGBB\b|\bBALL\s*BRG\b|\b6[23]\d{2}(-?2RS|-?ZZ)?\b|\bNU\s?\d{3,4}\b|\b2[23]\d{3}\b",
    CABLE: r"\bCABLE\b|\bCBL\b|\bXLPE\b|\bSQ\.?\s?MM\b|\bCORE\b.*\b(KV|VOLT)\b|\bARMOU?RED\b",
    FASTENER: r"\b(HEX|HEXAGON)\s*(HEAD)?\s*(BOLT|SCREW|NUT)\b|\bBOLT\b|\bNUT\b|\bWASHER\b|\bWSHR\b|\bSTUD\b|\bSCREW\b"
    r"|\bM\d{1,2}\s*[Xx]\s*\d{2,3}\b",
    PIPE: r"\bPIPE\b|\bTUBE\b|\bSEAMLESS\b|\bSMLS\b|\bERW\b|\bSCH\s?\d{2,3}\b|\bSCHEDULE\s?\d{2,3}\b",
}
HEAD_NOUNS = {
    "VALVE": VALVE,
    "BEARING": BEARING,
    "CABLE": CABLE,
    "PIPE": PIPE,
    "BOLT": FASTENER,
    "WASHER": FASTENER,
    "SCREW": FASTENER,
}

# ---- fixed values: normalization -----------------------------------------------------------

QUOTES_FROM, QUOTES_TO = "’‘“”″′", "''\"\"\"'"
#: Nominal pipe size in inches -> DN in millimetres.
INCH_TO_DN = {
    0.125: 6, 0.25: 8, 0.375: 10, 0.5: 15, 0.75: 20, 1.0: 25, 1.25: 32, 1.5: 40, 2.0: 50, 2.5: 65,
    3.0: 80, 3.5: 90, 4.0: 100, 5.0: 125, 6.0: 150, 8.0: 200, 10.0: 250, 12.0: 300, 14.0: 350, 16.0: 400,
    18.0: 450, 20.0: 500, 22.0: 550, 24.0: 600, 28.0: 700, 30.0: 750, 32.0: 800, 36.0: 900, 40.0: 1000, 48.0: 1200,
}
#: Spelled fractions that the size rule knows.
FRACTIONS = {
    "1/8": 0.125, "1/4": 0.25, "3/8": 0.375, "1/2": 0.5, "3/4": 0.75, "1-1/4": 1.25, "1 1/4": 1.25,
    "1-1/2": 1.5, "1 1/2": 1.5, "2-1/2": 2.5, "2 1/2": 2.5, "3-1/2": 3.5,
}
SIZED = (VALVE, PIPE)
INCH_MARK = r"(?:\"|''|INCH(?:ES)?|IN\b)"
FRACTION_PATTERN = r"(?i)(?<![\d.])(?:\d+[-\s]+)?\d\s*/\s*\d(?=\s*" + INCH_MARK + ")"
NB_PATTERN = r"(?i)(?<![\w.])(\d{1,4})\s*(?:NB|NOMINAL\s+BORE)\b"
INCH_PATTERN = r"(?i)(?<![\w.])(\d+(?:[-\s]\d/\d)?(?:\.\d+)?|\d/\d)\s*" + INCH_MARK
MM_PATTERN = r"(?i)(?<![\w.])(\d{1,4})(?:\.0)?\s*MM\b"
DN_PATTERN = r"(?i)\bDN\s*(\d{1,4})\b"

ABBREVIATIONS = {
    "VLV": "VALVE", "VV": "VALVE", "GT": "GATE", "GLB": "GLOBE", "CHK": "CHECK", "BFLY": "BUTTERFLY",
    "BALLV": "BALL VALVE", "SS": "STAINLESS STEEL", "STL": "STEEL", "CS": "CARBON STEEL", "MS": "MILD STEEL",
    "GI": "GALVANIZED IRON", "DI": "DUCTILE IRON", "CI": "CAST IRON", "CU": "COPPER", "ALU": "ALUMINIUM",
    "ALUM": "ALUMINIUM", "ALUMINUM": "ALUMINIUM", "FLGD": "FLANGED", "FLG": "FLANGE", "FLNG": "FLANGE",
    "SCRD": "SCREWED", "THRD": "THREADED", "THD": "THREADED", "BW": "BUTT WELD", "SW": "SOCKET WELD",
    "RF": "RAISED FACE", "SMLS": "SEAMLESS", "ERW": "ELECTRIC RESISTANCE WELDED", "BRG": "BEARING",
    "BB": "BALL BEARING", "DGBB": "DEEP GROOVE BALL BEARING", "SPH": "SPHERICAL", "CYL": "CYLINDRICAL",
    "RLR": "ROLLER", "CBL": "CABLE", "CDR": "CONDUCTOR", "COND": "CONDUCTOR", "ARMD": "ARMOURED",
    "ARM": "ARMOURED", "ARMORED": "ARMOURED", "UNARMD": "UNARMOURED", "UNARMORED": "UNARMOURED", "C": "CORE",
    "AL": "ALUMINIUM", "HEX": "HEXAGON", "HD": "HEAD", "SCR": "SCREW", "BLT": "BOLT", "WSHR": "WASHER",
    "PLTD": "PLATED", "ZN": "ZINC", "GALV": "GALVANIZED", "HDG": "HOT DIP GALVANIZED", "SCH": "SCHEDULE",
    "GR": "GRADE", "MTL": "MATERIAL", "ASSY": "ASSEMBLY", "QTY": "QUANTITY", "PRESS": "PRESSURE",
    "TEMP": "TEMPERATURE", "NOM": "NOMINAL", "DIA": "DIAMETER",
}
#: Abbreviations that hold in one category only.
SCOPED = {
    "C": CABLE, "AL": CABLE, "CDR": CABLE, "COND": CABLE, "RLR": BEARING, "SPH": BEARING, "CYL": BEARING,
    "HD": FASTENER, "SCR": FASTENER, "BLT": FASTENER,
}

# ---- fixed values: attribute patterns ------------------------------------------------------

#: Grade, pattern; the first that fits wins.
MATERIALS = (
    ("STAINLESS STEEL 316L", r"\b(?:SS|AISI|ASTM|UNS|TYPE|GRADE|STAINLESS\s+STEEL)?[\s\-]*316\s?L\b"),
    ("STAINLESS STEEL 316L", r"\bS31603\b|\bF316L\b|\bCF3M\b"),
    ("STAINLESS STEEL 316", r"\b(?:SS|AISI|ASTM|UNS|TYPE|GRADE|STAINLESS\s+STEEL)[\s\-]*316\b(?!\s?L\b)"),
    ("STAINLESS STEEL 316", r"\bS31600\b|\bF316\b(?!L)|\bCF8M\b"),
    ("STAINLESS STEEL 304L", r"\b(?:SS|AISI|ASTM|UNS|TYPE|GRADE|STAINLESS\s+STEEL)?[\s\-]*304\s?L\b"),
    ("STAINLESS STEEL 304L", r"\bS30403\b|\bF304L\b|\bCF3\b"),
    ("STAINLESS STEEL 304", r"\b(?:SS|AISI|ASTM|UNS|TYPE|GRADE|STAINLESS\s+STEEL)[\s\-]*304\b(?!\s?L\b)"),
    ("STAINLESS STEEL 304", r"\bS30400\b|\bF304\b(?!L)|\bCF8\b"),
    ("STAINLESS STEEL 321", r"\b(?:SS|AISI|TYPE)?[\s\-]*321\b"),
    ("DUPLEX STAINLESS STEEL 2205", r"\b2205\b|\bS31803\b|\bS32205\b"),
    ("ALLOY STEEL A182 F11", r"\bF11\b|\bA182\s*F11\b"),
    ("ALLOY STEEL A182 F22", r"\bF22\b|\bA182\s*F22\b"),
    ("ALLOY STEEL A193 B7", r"\bA193\s*(?:GRADE\s*)?B7\b|\bB7\b"),
    (
        "CARBON STEEL",
        r"\bCARBON\s+STEEL\b|\bA216\s*(?:GRADE\s*)?WCB\b|\bWCB\b|\bA105\b|\bA106\b|\bA53\b|\bASTM\s*A106\b",
    ),
    ("CAST IRON", r"\bCAST\s+IRON\b"),
    ("DUCTILE IRON", r"\bDUCTILE\s+IRON\b|\bSG\s+IRON\b"),
    ("GALVANIZED IRON", r"\bGALVANIZED\s+IRON\b"),
    ("MILD STEEL", r"\bMILD\s+STEEL\b"),
    ("BRONZE", r"\bBRONZE\b|\bGUNMETAL\b"),
    ("BRASS", r"\bBRASS\b"),
    ("ALUMINIUM", r"\bALUMINIUM\b"),
    ("COPPER", r"\bCOPPER\b"),
    ("STAINLESS STEEL", r"\bSTAINLESS\s+STEEL\b"),
)
MAKERS = (
    "KSB|AUDCO|LEADER|BDK|IVC|FOURESS|MICROFINISH|SKF|FAG|NTN|NSK|TIMKEN|KOYO|SCHAEFFLER|POLYCAB|HAVELLS|KEI|FINOLEX"
    "|RR KABEL|GLOSTER|JINDAL|TATA|MAHARASHTRA SEAMLESS|ISMT|UNBRAKO|SUNDRAM|TVS|APL APOLLO"
)
PART_NUMBER = r"\b(?:PN|P/N|PART|OEM|MAKE)[\s:#-]*([A-Z0-9][A-Z0-9\-/]{3,})\b"
_RATINGS = "150|300|400|600|800|900|1500|2500"
CLASS_PATTERN = (
    rf"\b(?:CL|CLASS|ANSI|ASME)\s*[#]?\s*({_RATINGS})\b|\b({_RATINGS})\s*#|#\s*({_RATINGS})\b"
)
PN_PATTERN = r"\bPN\s*(\d{1,3})\b"
END_PATTERN = r"\b(FLANGED|FLANGE|BUTT\s+WELD|SOCKET\s+WELD|SCREWED|THREADED|WAFER|LUG)\b"
VALVE_STANDARD = r"\b(API\s*6D|API\s*600|API\s*602|BS\s*1868|BS\s*5352|IS\s*14846|ASME\s*B16\.34)\b"
SCHEDULE_PATTERN = (
    r"\b(?:SCHEDULE|SCH)\s*[.:#]?\s*(5S|10S|40S|80S|5|10|20|30|40|60|80|100|120|140|160)\b|\b(XXS|XS|STD)\b"
)
PIPE_STANDARD = (
    r"\b(ASTM\s*A106\s*(?:GRADE\s*|GR\s*)?[AB]?|ASTM\s*A53|API\s*5L|IS\s*1239|IS\s*3589|ASTM\s*A312)\b"
)
PIPE_TYPE = r"\b(SEAMLESS|ELECTRIC RESISTANCE WELDED|WELDED|SPIRAL)\b"
DESIGNATION = r"\b(N[UJ]\s?\d{3,4}|\d{4,5})\s*[-]?\s*(2RS1|2RS|2Z|ZZ|RS|C3|C4)?\b"
BEARING_TYPE = (
    r"\b(DEEP GROOVE BALL BEARING|SPHERICAL ROLLER BEARING|CYLINDRICAL ROLLER BEARING|TAPER(?:ED)? ROLLER BEARING"
    r"|ANGULAR CONTACT BALL BEARING|BALL BEARING|ROLLER BEARING|BEARING)\b"
)
#: Measurement -> the words that name it.
MEASURES = {"bore_mm": r"BORE|INSIDE\s+DIAMETER|ID", "outer_diameter_mm": r"OUTSIDE\s+DIAMETER|OD", "width_mm": r"WIDTH|W"}
MEASURE_CONFIDENCE = {"bore_mm": 0.98, "outer_diameter_mm": 0.97, "width_mm": 0.95}
SEAL_PATTERN = r"\b(2RS1|2RS|2Z|ZZ|RS|OPEN|SEALED|SHIELDED)\b"
SEALS = {"2RS1": "2RS", "RS": "2RS", "Z": "ZZ", "2Z": "ZZ", "SEALED": "2RS", "SHIELDED": "ZZ"}
BORE_CODES = {"00": 10.0, "01": 12.0, "02": 15.0, "03": 17.0}
_AREA = r"(?:SQ\.?\s*MM|SQMM|MM2|MM\^2|SQUARE\s*MM)\b"
CORES_PATTERN = r"\b(\d{1,2})\s*(?:CORES|CORE|CX|C)(?![A-Z])"
AREA_PATTERN = r"(?<![\d.])(\d{1,4}(?:\.\d+)?)\s*" + _AREA
CORES_AREA_PATTERN = r"(?<![\d.])(\d{1,2})\s*(?:CORES|CORE|C)\s*[X*]\s*(\d{1,4}(?:\.\d+)?)\s*" + _AREA
LOW_TENSION_PATTERN = r"\b650\s*[/\s]\s*1100\s*(?:V|VOLTS?)?\b"
KV_PATTERN = r"(?<![\d.])(\d{1,3}(?:\.\d+)?)\s*KV\b"
VOLT_PATTERN = r"(?<![\d.])(\d{3,5})\s*(?:V|VOLTS?)\b"
KV_GRADES = (0.65, 1.1, 3.3, 6.6, 11.0, 22.0, 33.0, 66.0, 132.0)
INSULATION_PATTERN = r"\b(XLPE|PVC|EPR|RUBBER|FRLS)\b"
ARMOUR_PATTERN = r"\b(UNARMOURED|ARMOURED)\b"
CONDUCTOR_PATTERN = r"\b(ALUMINIUM|COPPER)\b"
#: Case-sensitive.
THREAD_PATTERN = r"\bM\s?(\d{1,2})(?:\s*[X*]\s*(\d{1,3}(?:\.\d+)?))?\b"
LENGTH_PATTERN = r"\b(?:LENGTH|LG|L)\s*[:=]?\s*(\d{1,4})\s*MM\b"
PROPERTY_PATTERN = r"\b(?:GRADE|CLASS|PROPERTY\s*CLASS)?\s*(4\.6|5\.6|5\.8|8\.8|10\.9|12\.9)\b"
STAINLESS_PROPERTY = r"\b(A2-?70|A4-?80|A2|A4)\b"
FINISH_PATTERN = r"\b(HOT DIP GALVANIZED|GALVANIZED|ZINC PLATED|ZINC|PLAIN|BLACK|PTFE COATED)\b"
FASTENER_TYPE = (
    r"\b(HEXAGON HEAD BOLT|HEX HEAD BOLT|HEXAGON BOLT|HEXAGON NUT|HEX NUT|STUD BOLT|STUD|BOLT|NUT|WASHER|SCREW)\b"
)
FASTENER_TYPES = {"HEX HEAD BOLT": "HEXAGON HEAD BOLT", "HEXAGON BOLT": "HEXAGON HEAD BOLT", "HEX NUT": "HEXAGON NUT"}
FASTENER_STANDARD = (
    r"\b(IS\s*1364|IS\s*1367|ASTM\s*A193\s*(?:GRADE\s*|GR\s*)?B7|ASTM\s*A194|DIN\s*931|DIN\s*933|ISO\s*4014)\b"
)

# ---- fixed values: attribute keys by category, in display order ---------------------------

SCHEMAS = {
    VALVE: ("item_type", "size", "material", "pressure_class", "end_connection", "standard", "oem"),
    PIPE: ("item_type", "size", "material", "schedule", "manufacture", "standard", "oem"),
    BEARING: ("item_type", "designation", "bore_mm", "outer_diameter_mm", "width_mm", "seal_type", "oem"),
    CABLE: (
        "item_type", "cores", "cross_section_sqmm", "voltage_grade", "conductor_material", "insulation", "armour", "oem",
    ),
    FASTENER: (
        "item_type", "thread_size", "length_mm", "property_class", "material", "finish", "standard", "oem",
    ),
}
#: Keys of a description, in order.
DESCRIPTION_KEYS = {
    VALVE: ("item_type", "size", "material", "pressure_class", "end_connection", "standard"),
    PIPE: ("item_type", "size", "material", "schedule", "manufacture", "standard"),
    BEARING: ("item_type", "designation", "bore_mm", "outer_diameter_mm", "width_mm", "seal_type"),
    CABLE: (
        "item_type", "cores", "cross_section_sqmm", "conductor_material", "insulation", "voltage_grade", "armour",
    ),
    FASTENER: ("item_type", "thread_size", "length_mm", "property_class", "material", "finish", "standard"),
}
DESCRIPTION_SUFFIX = {
    "bore_mm": " MM BORE", "outer_diameter_mm": " MM OD", "width_mm": " MM WIDTH", "cross_section_sqmm": " SQ MM",
    "length_mm": " MM LONG", "cores": " CORE",
}
NO_DESCRIPTION = "UNSPECIFIED MATERIAL"

# ---- fixed values: comparison, safety, scoring ---------------------------------------------

TOLERANCE = {
    "bore_mm": 0.01, "outer_diameter_mm": 0.01, "width_mm": 0.01, "cross_section_sqmm": 0.01, "length_mm": 0.01, "cores": 0.0,
}
HIERARCHICAL = ("item_type", "finish", "manufacture")
EQUIVALENT_KEY = "pressure_class"
EQUIVALENCES = (
    ("PN20", "CL150", 0.90), ("PN50", "CL300", 0.90), ("PN68", "CL400", 0.85), ("PN100", "CL600", 0.90),
    ("PN150", "CL900", 0.85), ("PN250", "CL1500", 0.85), ("PN420", "CL2500", 0.85), ("PN16", "CL150", 0.60),
    ("PN40", "CL300", 0.60),
)
EQUIVALENCE_FLOOR = 0.85
CRITICAL = {
    VALVE: ("material", "pressure_class", "size"),
    PIPE: ("material", "schedule", "size"),
    BEARING: ("designation", "bore_mm", "seal_type"),
    CABLE: ("voltage_grade", "conductor_material", "cross_section_sqmm", "cores"),
    FASTENER: ("thread_size", "property_class", "length_mm"),
}
#: A critical field that counts only when either item is of one of these kinds.
CONDITIONAL = {"length_mm": ("HEXAGON HEAD BOLT", "STUD BOLT", "BOLT", "SCREW", "STUD")}
#: Semantic, lexical and attribute share; weights by key.
WEIGHTS = {
    VALVE: (0.35, 0.15, 0.50, {"item_type": 1.0, "size": 0.9, "material": 1.0, "pressure_class": 1.0, "end_connection": 0.4, "standard": 0.3, "oem": 0.1}),
    PIPE: (0.35, 0.15, 0.50, {"item_type": 1.0, "size": 0.9, "material": 1.0, "schedule": 1.0, "manufacture": 0.3, "standard": 0.4, "oem": 0.1}),
    BEARING: (0.25, 0.25, 0.50, {"item_type": 0.6, "designation": 1.0, "bore_mm": 1.0, "outer_diameter_mm": 0.9, "width_mm": 0.6, "seal_type": 0.7, "oem": 0.15}),
    CABLE: (0.30, 0.15, 0.55, {"item_type": 0.5, "cores": 1.0, "cross_section_sqmm": 1.0, "voltage_grade": 1.0, "conductor_material": 1.0, "insulation": 0.6, "armour": 0.4, "oem": 0.1}),
    FASTENER: (0.30, 0.20, 0.50, {"item_type": 0.8, "thread_size": 1.0, "length_mm": 0.9, "property_class": 1.0, "material": 0.7, "finish": 0.3, "standard": 0.3, "oem": 0.1}),
}
FALLBACK_WEIGHTS = (0.45, 0.25, 0.30)
ZERO_SUM_WEIGHTS = (0.34, 0.16, 0.50)
KEY_WEIGHT = 0.25
PENALTY_CRITICAL, PENALTY_OTHER, SOFTENING, LEAST_TRUST = 2.5, 1.2, 0.3, 0.4
MERGE_AT, REVIEW_AT, CANDIDATES = 0.58, 0.42, 30
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
