"""The patterns that find fields in scanned documents.

Written for java.util.regex, with boundaries that know ASCII only.  Devanagari
alternatives stand without a boundary, since an ASCII boundary would never match
beside them.
"""

from tallygrain.constants import KNOWN_DISTRICTS

_L = "(?<![A-Za-z0-9_])"
_R = "(?![A-Za-z0-9_])"
_B = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# --- identity card ---------------------------------------------------------
CARD_LATIN_NAME = rf"{_L}([A-Z][a-z]+(?:\s+[A-Z][a-z]+){{0,2}}){_R}\s*\n?\s*(?:DoB|DOB|जन्म)"
CARD_DEVA_NAME = r"([ऀ-ॿ][ऀ-ॿ\s]{2,40}?)\s*\n\s*[A-Z][a-z]+"
CARD_LABELLED_NAME = r"(?i)(?:name|naam|नाम)\s*[:\-]\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ .]{2,60})"
CARD_DOB = rf"{_L}(\d{{2}}[/-]\d{{2}}[/-]\d{{4}}){_R}"
CARD_DOB_ISO = rf"{_L}(\d{{4}}[-/]\d{{2}}[-/]\d{{2}}){_R}"
CARD_NUMBER = rf"{_L}([0-9oOlI]{{4}}[\s-]?[0-9oOlIxX]{{4}}[\s-]?[0-9oOlIxX]{{4}}){_R}"
CARD_FEMALE = rf"(?i){_L}female{_R}|महिला"
CARD_MALE = rf"(?i){_L}male{_R}|पुरुष"

# --- land record -----------------------------------------------------------
DEED_BUYER = (
    r"(?i)(?:क्रेता|खरीदार|प्रथम\s*पक्ष|हकदार)\s*[:\-]?\s*([A-Za-zऀ-ॿ][A-Za-zऀ-ॿ\s]{2,35}?)"
    r"(?=\s+(?:पुत्र|पुत्री|पत्नी|निवासी|उम्र|जाति|पार्टी)|\z)"
)
DEED_RELATION = (
    r"(?i)(?:पुत्र|पुत्री|पत्नी|s/o|d/o|w/o|son of|daughter of|wife of)\s*[:\-]?\s*"
    r"([ऀ-ॿ][ऀ-ॿ\s]{2,40}|[A-Z][A-Za-z\s]{2,40})"
)
DEED_LABELLED = (
    r"(?:नाम|स्वामी|खातेदार|owner|name)\s*[:\-]?\s*([ऀ-ॿ][ऀ-ॿ\s]{2,40}|[A-Z][A-Za-z\s]{2,40})"
)
DEED_JUNK_OWNER = r"(?i)^(?:wo|go0|af|urpha|shri|sri|mr|the|and|[a-z]{1,2})\z"
DEED_DISTRICT = rf"(?i)(?:जिला|{_L}(?:district|dist\.?))\s*[:\-]?\s*([A-Za-zऀ-ॿ]{{3,25}})"
DEED_DISTRICT_KNOWN = rf"(?i){_L}({'|'.join(KNOWN_DISTRICTS)}){_R}"
DEED_VILLAGE = rf"(?i)(?:ग्राम|गांव|मौजा|{_L}village)\s*[:\-]?\s*([ऀ-ॿ]{{2,25}}|[A-Za-z]{{2,25}})"
DEED_TYPE = r"(?i)(विक्रय विलेख|खतौनी|खसरा|फर्द|sale deed|registry|khatauni|khasra|इकरारनामा)"
DEED_DATE_WORDS = rf"{_L}(\d{{1,2}}\s+[A-Z][a-z]{{2,8}}\s+\d{{4}}){_R}"
DEED_DATE_DIGITS = CARD_DOB
DEED_KHASRA = (
    r"(?i)(?:खसरा\s*(?:नं0?|संख्या)?|khasra\s*(?:no\.?|num)?|survey\s*(?:no\.?|num)?|गाटा\s*(?:संख्या)?)"
    r"\s*[:\-#]?\s*([0-9]+(?:/[0-9]+)?)"
)
DEED_AREA = r"(?i)(?:रकबा|क्षेत्रफल|area)\s*[:\-]?\s*([0-9.]+\s*(?:हेक्टेयर|हे0|बीघा|एकड़|hectare|acre)?)"
DEED_STATE = (
    rf"(?i)(उत्तर प्रदेश|महाराष्ट्र|मध्य प्रदेश|राजस्थान|बिहार|हरियाणा|गुजरात|"
    rf"{_L}(?:uttar pradesh|maharashtra|madhya pradesh|bihar){_R})"
)
DEED_AMOUNT = r"(?i)(?:₹|rs\.?|रू0?|रु)\s*([\d,]{4,12})"
DEED_AMOUNT_SLASH = rf"{_B}([\d,]{{6,12}})\s*/"
DEED_PERSON_LINES = (
    r"(?i)([ऀ-ॿ][ऀ-ॿ\s]{2,40}?|[A-Z][A-Za-z\s]{2,40}?)\s*(?:पुत्र|पुत्री|पत्नी|s/o|d/o|w/o)"
)

# --- policy paper ----------------------------------------------------------
PAPER_NUMBER_LINE = r"(?i)policy\s*(?:no\.?|number|संख्या)\s*[:\-]?\s*([A-Z0-9][A-Z0-9/-]{5,24})"
PAPER_NUMBER_SLASHES = rf"{_L}([A-Z]{{2,5}}/\d{{2,4}}/[A-Z]{{2,4}}/\d{{3,8}}){_R}"
PAPER_NUMBER_DASHES = rf"{_L}([A-Z]{{2,5}}[-/]\d{{2}}[-/]\d{{3,6}}){_R}"
PAPER_INSURED_LINE = (
    r"(?i)(?:insured|claimant|farmer|नाम)\s*(?:name)?\s*[:\-]\s*"
    r"([A-Z][A-Za-z]+(?:\s+[A-Z][a-z]+){0,2}(?=\s*(?:Sum|Policy|Season|Coverage)|\s*\z)|[ऀ-ॿ][ऀ-ॿ\s]{2,60})"
)
PAPER_INSURED_FLAT = (
    r"(?i)(?:insured|claimant|farmer)\s*(?:name)?\s*[:\-]\s*"
    rf"([A-Z][A-Za-z]+(?:\s+[A-Z][a-z]+){{0,2}})(?=\s+(?:Sum|Policy|Season|Coverage){_R})"
)
PAPER_SUM = (
    r"(?i)(?:sum insured|insured amount|बीमा राशि|विमा राशि)\s*[:\-]?\s*(?:₹|rs\.?|inr)?\s*([\d,]+(?:\.\d{1,2})?)"
)
PAPER_SUM_ANY = r"(?i)(?:₹|rs\.?)\s*([\d,]{4,12})"
PAPER_COVERAGE = [
    ("flood", rf"(?i){_L}flood|बाढ़"),
    ("drought", rf"(?i){_L}drought|सूखा|अनावृष्टि"),
    ("livestock", rf"(?i){_L}livestock|पशु|cattle"),
]

# --- bill ------------------------------------------------------------------
BILL_NUMBERS = [
    rf"(?i){_L}(MH-\d{{2}}-\d{{4}}){_R}",
    rf"(?i){_L}(PMFBY/[A-Z0-9/-]{{4,28}}){_B}",
    rf"(?i){_L}(?:policy|pol|cover|cert(?:ificate)?)\s*(?:no\.?|num|#)?\s*[:\-]?\s*([A-Z0-9][A-Z0-9/-]{{4,24}}){_B}",
    rf"(?i){_L}([A-Z]{{2,5}}[-/]\d{{2,4}}[-/][A-Z0-9/-]{{4,16}}){_B}",
]
BILL_AMOUNTS = [
    r"(?i)(?:rs\.?|inr|₹|रू0?|रु)\s*([\d,]+(?:\.\d{1,2})?)",
    r"(?i)(?:claim|bill|total|loss|net|insured|sum insured)\s*(?:amount|value|sum)?\s*[:\-]?\s*(?:rs\.?|inr|₹|रू)?"
    r"\s*([\d,]+(?:\.\d{1,2})?)",
]
BILL_NAMES = [
    r"(?i)(?:insured|claimant|farmer|holder|beneficiary|नाम|क्रेता)\s*(?:name)?\s*[:\-]\s*"
    r"([A-Za-zऀ-ॿ]+(?:\s+[A-Za-zऀ-ॿ]+){0,2})",
    rf"(?i){_L}(?:shri|smt|mr|mrs)\.?\s+([A-Za-zऀ-ॿ]+(?:\s+[A-Za-zऀ-ॿ]+){{1,2}})",
    r"(?i)(?:name|naam)\s*[:\-]\s*([A-Za-z]+(?:\s+[A-Za-z]+){0,2})",
]
BILL_NAME_STOPS = ["total", "amount", "bill", "rs", "inr"]
BILL_AMOUNT_LIMIT = 10_000_000

# words of which one stands, lower-cased, in every match of a pattern; patterns are tried only where it does
_DIGITS, KIN = list("0123456789"), ["पुत्र", "पत्नी", "s/o", "d/o", "w/o"]
_RUPEES = ["₹", "rs", "रू", "रु"]
ANCHORS = {
    CARD_LATIN_NAME: ["dob", "जन्म"],
    CARD_LABELLED_NAME: ["name", "naam", "नाम"],
    CARD_DOB: _DIGITS,
    CARD_DOB_ISO: _DIGITS,
    CARD_FEMALE: ["female", "महिला"],
    CARD_MALE: ["male", "पुरुष"],
    DEED_BUYER: ["क्रेता", "खरीदार", "प्रथम", "हकदार"],
    DEED_RELATION: [*KIN, "son of", "daughter of", "wife of"],
    DEED_LABELLED: ["नाम", "स्वामी", "खातेदार", "owner", "name"],
    DEED_DISTRICT: ["जिला", "dist"],
    DEED_DISTRICT_KNOWN: KNOWN_DISTRICTS,
    DEED_VILLAGE: ["ग्राम", "गांव", "मौजा", "village"],
    DEED_TYPE: ["विक्रय विलेख", "खतौनी", "खसरा", "फर्द", "sale deed", "registry", "khatauni", "khasra", "इकरारनामा"],
    DEED_DATE_WORDS: _DIGITS,
    DEED_KHASRA: ["खसरा", "khasra", "survey", "गाटा"],
    DEED_AREA: ["रकबा", "क्षेत्रफल", "area"],
    DEED_STATE: ["प्रदेश", "महाराष्ट्र", "राजस्थान", "बिहार", "हरियाणा", "गुजरात", "pradesh", "maharashtra", "bihar"],
    DEED_AMOUNT: _RUPEES,
    DEED_AMOUNT_SLASH: ["/"],
    PAPER_NUMBER_LINE: ["policy"],
    PAPER_NUMBER_SLASHES: ["/"],
    PAPER_NUMBER_DASHES: ["/", "-"],
    PAPER_INSURED_LINE: ["insured", "claimant", "farmer", "नाम"],
    PAPER_INSURED_FLAT: ["insured", "claimant", "farmer"],
    PAPER_SUM: ["insured", "राशि"],
    PAPER_SUM_ANY: ["₹", "rs"],
    BILL_NUMBERS[0]: ["mh-"],
    BILL_NUMBERS[1]: ["pmfby/"],
    BILL_NUMBERS[2]: ["pol", "cover", "cert"],
    BILL_NUMBERS[3]: ["-", "/"],
    BILL_AMOUNTS[0]: [*_RUPEES, "inr"],
    BILL_AMOUNTS[1]: ["claim", "bill", "total", "loss", "net", "insured"],
    BILL_NAMES[0]: ["insured", "claimant", "farmer", "holder", "beneficiary", "नाम", "क्रेता"],
    BILL_NAMES[1]: ["shri", "smt", "mr"],
    BILL_NAMES[2]: ["name", "naam"],
}
