"""Values that results depend on.

Everything in this file is a fixed value: thresholds, codes, word lists and
small lookup tables that have to be exactly these for results to be right.
"""

# --- fixed values: statuses and their ledger codes ------------------------
STATUS_CODE = {
    "SUBMITTED": 0,
    "AI_APPROVED": 1,
    "AI_FLAGGED": 2,
    "HUMAN_OVERRIDDEN": 3,
    "PAID": 4,
    "REJECTED": 5,
    "HUMAN_REVIEW": 6,
    "HUMAN_APPROVED": 7,
    "HUMAN_REJECTED": 8,
    "AI_REJECTED": 5,
}
STATUSES = list(STATUS_CODE)

STATUS_GROUPS = {
    "approved": ["AI_APPROVED", "HUMAN_APPROVED"],
    "flagged": ["AI_FLAGGED", "HUMAN_REVIEW"],
    "rejected": ["AI_REJECTED", "HUMAN_REJECTED", "REJECTED"],
    "paid": ["PAID"],
}
PAYABLE = ["AI_APPROVED", "HUMAN_APPROVED"]
TERMINAL = ["PAID", "HUMAN_REJECTED"]
COMPUTED_VERDICTS = ["AI_APPROVED", "AI_FLAGGED", "AI_REJECTED"]
NEVER_REQUESTED = ["SUBMITTED", "HUMAN_OVERRIDDEN", "REJECTED"]
# requested status -> (allowed current statuses, least note length)
HUMAN_STEPS = {
    "HUMAN_APPROVED": (["AI_FLAGGED", "AI_REJECTED"], 20),
    "HUMAN_REJECTED": (["AI_FLAGGED", "AI_REJECTED"], 20),
    "HUMAN_REVIEW": (["AI_REJECTED"], 1),
}
LEAKAGE_STATUSES = ["AI_FLAGGED", "REJECTED", "HUMAN_REJECTED"]
GENUINE_STATUSES = ["AI_APPROVED", "HUMAN_APPROVED", "PAID"]
FRAUD_STATUSES = ["AI_FLAGGED", "REJECTED", "HUMAN_REJECTED"]

# --- fixed values: intake limits ------------------------------------------
LOSS_TYPES = ["flood", "drought", "livestock"]
MAX_NAME = 120
MAX_NOTE = 280
MAX_POLICY = 40
MAX_AMOUNT = 100_000
MAX_FILE_BYTES = 10 * 1024 * 1024
MAX_FILES = 11
MAX_PER_KIND = {
    "photo": 6,
    "bill": 3,
    "id": 2,
    "registry": 2,
    "aadhaar": 2,
    "satellite": 2,
    "policy": 2,
}
ALLOWED_MIME = ["image/jpeg", "image/png", "image/heic", "image/heif", "application/pdf"]
# order in which the kinds are listed in a claim's evidence
KIND_ORDER = ["photo", "satellite", "bill", "id", "registry", "aadhaar", "policy"]
FARMER_DOCS = ["registry", "aadhaar", "policy"]
IMAGE_KINDS = ["photo", "satellite"]

# --- fixed values: scores and thresholds ----------------------------------
FAIL_COST = 25
WARN_COST = 12
APPROVE_AT = 50
REJECT_BELOW = 20
PHASH_BITS = 64
PHASH_CROSS = 6
PHASH_WITHIN = 2
RELEVANCE_FLAG = 50
RELEVANCE_PASS = 65
KNN_K = 5
KNN_FAIL = 60
MEMORY_PER_LABEL = 500
STAGED_WARN = 55
STAGED_FAIL = 75
AIGEN_WARN = 78
AIGEN_FAIL = 88
DELTA_FLAG = 40
REASONS_SHOWN = 4
SIMILAR_SHOWN = 5
EARTH_KM = 6371.0
NEAR_KM = 45
SERVICE_KM = 120
UNRESOLVED_KM = 80
NDVI_DROP = 0.25
WINDOW_BEFORE_DAYS = 10
WINDOW_AFTER_DAYS = 5
INTAKES_PER_MINUTE = 12
REQUESTS_PER_MINUTE = 300
RECENT_BLOCKS = 10_000
RECENT_MAX = 100
RECENT_DEFAULT = 25

STAGES = [
    "EXIF_INTEGRITY",
    "DUPLICATE_PHASH",
    "OCR_EXTRACT",
    "POLICY_MATCH",
    "DOC_CROSS",
    "DAMAGE_ASSESS",
    "FRAUD_RULES",
    "DECISION",
]

# --- fixed values: loss types ---------------------------------------------
LOSS_META = {
    "flood": {
        "label": "Flood",
        "terms": ["flood", "water", "soaked", "drowned", "inundated", "rain", "muddy"],
        "districts": ["yavatmal", "nanded", "thane", "bhiwandi", "amravati"],
    },
    "drought": {
        "label": "Drought",
        "terms": ["drought", "dry", "cracked", "withered", "parched"],
        "districts": ["nanded", "yavatmal", "solapur", "latur"],
    },
    "livestock": {
        "label": "Livestock",
        "terms": ["livestock", "cattle", "cow", "ox", "buffalo", "goat", "injured", "deceased"],
        "districts": ["yavatmal", "nanded", "amravati", "akola"],
    },
}

# --- fixed values: district centroids (name, latitude, longitude) ----------
DISTRICTS = [
    ("yavatmal", 19.8697, 77.3091),
    ("nanded", 19.1383, 77.321),
    ("thane", 19.2203, 72.9781),
    ("bhiwandi", 19.3002, 73.0631),
    ("amravati", 20.9374, 77.7796),
    ("solapur", 17.6599, 75.9064),
    ("latur", 18.4004, 76.9444),
    ("akola", 20.7002, 77.0082),
]

# --- fixed values: policies (number, holder, limit, covered losses) --------
POLICIES = [
    ("MH-12-9931", "Ramesh Kumar", 10000, ["flood", "drought"]),
    ("MH-27-4102", "Devendra Singh", 12000, ["flood", "livestock"]),
    ("MH-22-7789", "Sunita Pawar", 8000, ["drought", "flood"]),
    ("MH-31-2255", "Generic Farmer Policy", 10000, ["flood", "drought", "livestock"]),
]
GENERIC_HOLDER = "Generic Farmer Policy"

# --- fixed values: destruction ladder (rung, weight), from intact to severe -
LADDER = [("intact", 0), ("wet", 18), ("waterlogged", 38), ("submerged", 62), ("heavy", 82), ("severe", 95)]
LADDER_FACTOR = 12
LADDER_REFERENCE_SHIFT = -8
# --- fixed values: NDVI rungs, highest first --------------------------------
NDVI_RUNGS = [(75, "D4 catastrophic"), (50, "D3 severe"), (25, "D2 moderate"), (10, "D1 slight"), (0, "D0 healthy")]

# --- fixed values: words that tell a document's role -------------------------
ROLE_SIGNS = {
    "aadhaar": [
        "aadhaar", "aadhar", "आधार", "uidai", "unique identification",
        "भारत सरकार", "government of india", "जन्म तिथि", "dob", "male", "female",
    ],
    "registry": [
        "विक्रय", "खतौनी", "खसरा", "राजस्व", "उत्तर प्रदेश", "मध्य प्रदेश", "महाराष्ट्र",
        "registry", "registrar", "sale deed", "khatauni", "khasra", "7/12", "फर्द", "गांव", " tehsil", "tehsil",
    ],
    "policy": [
        "policy", "insurance", "insured", "premium", "sum insured", "बीमा", "पॉलिसी",
        "pmfbry", "pmfby", "pradhan mantri fasal", "nominee", "coverage",
    ],
}

# --- fixed values: districts known by name in land records -------------------
KNOWN_DISTRICTS = [
    "muradabad", "moradabad", "ballia", "yavatmal", "nanded", "thane", "amravati",
    "akola", "solapur", "latur", "bhiwandi", "pune", "nashik", "nagpur", "aurangabad",
    "kolhapur", "satara", "jalgaon", "ahmednagar", "parbhani", "beed", "osmanabad",
    "washim", "hingoli", "wardha", "bhandara", "gondia", "chandrapur", "gadchiroli",
    "mumbai", "lucknow", "kanpur", "varanasi", "prayagraj", "gorakhpur", "bhopal",
    "indore", "patna", "jaipur", "muzaffarnagar", "meerut", "aligarh", "agra",
]

# --- fixed values: tokens that are not part of a name ------------------------
NAME_STOPS = ["shri", "smt", "mr", "mrs", "md", "s", "o", "d", "w", "putra", "putri"]

# --- fixed values: Devanagari letters and their Latin forms ------------------
CONSONANTS = {
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "n",
    "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "n",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n",
    "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m",
    "य": "y", "र": "r", "ल": "l", "व": "v", "ळ": "l",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
}
VOWELS = {
    "अ": "a", "आ": "a", "इ": "i", "ई": "i", "उ": "u", "ऊ": "u",
    "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au", "ऑ": "o",
}
MATRAS = {
    "ा": "a", "ि": "i", "ी": "i", "ु": "u", "ू": "u",
    "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "o", "ॉ": "o",
}
SIGNS = {"ं": "n", "ँ": "n", "ः": "h"}
DANDAS = "।॥"
VIRAMA = "्"
NUKTA = "़"

# --- fixed values: confidence of each extracted entity ------------------------
# (field, label, confidence)
REGISTRY_ENTITIES = [
    ("owner_name", "Owner / Buyer", 0.9),
    ("district", "District", 0.95),
    ("village", "Village", 0.85),
    ("khasra_no", "Khasra / Plot No.", 0.92),
    ("area_hectares", "Land Area", 0.88),
    ("deed_type", "Document Type", 0.95),
]
AADHAAR_ENTITIES = [
    ("name", "Cardholder Name", 0.96),
    ("name_devanagari", "Name (Devanagari)", 0.92),
    ("aadhaar_masked", "Aadhaar Number", 0.99),
    ("dob", "DOB / Year", 0.95),
    ("gender", "Gender", 0.98),
]
POLICY_ENTITIES = [
    ("policy_number", "Policy Number", 0.95),
    ("sum_insured", "Sum Insured", 0.92),
    ("insured_name", "Insured Farmer", 0.9),
]
BILL_ENTITIES = [
    ("policy_number", "policy", "Policy Number", 0.9),
    ("amount", "bill", "Bill Amount", 0.88),
    ("name", "policy", "Insured Name", 0.85),
]

ZERO_HASH = "0x" + "0" * 64
