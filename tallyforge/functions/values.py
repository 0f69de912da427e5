"""Fixed values of the cleaning rules: codes, digit maps, dictionaries, formats and messages."""

# Rule codes (fixed values)
RULE_DIGITS, RULE_CURRENCY, RULE_COMMAS, RULE_WORDS, RULE_PHONE = "RULE_01", "RULE_02", "RULE_03", "RULE_04", "RULE_05"
RULE_EMAIL, RULE_DATE, RULE_TEXT, RULE_TOTAL, RULE_SIGN = "RULE_06", "RULE_07", "RULE_08", "RULE_09", "RULE_10"

# Error codes (fixed values)
MISSING_ORDER_ID = "MISSING_ORDER_ID"
MISSING_CUSTOMER_ID = "MISSING_CUSTOMER_ID"
INVALID_DATE = "INVALID_IMPOSSIBLE_DATE"
CORRUPTED_ITEMS = "CORRUPTED_ITEMS_JSON"
EMPTY_ITEMS = "EMPTY_ITEMS"
UNKNOWN_PRICE = "UNKNOWN_PRICE"
NEGATIVE_VALUE = "AMBIGUOUS_NEGATIVE_VALUE"
SEVERAL_ERRORS = "MULTIPLE_CONFLICTING_ERRORS"
UNSAFE_EMAIL = "UNSAFE_EMAIL"

# Eastern digits with decimal and thousands marks, and what they stand for (fixed values)
EASTERN, WESTERN = "٠١٢٣٤٥٦٧٨٩٫٬", "0123456789.,"

# Amounts written as words (fixed values)
NUMBER_WORDS = {
    1000.0: ["ألف", "الف"],
    2000.0: ["ألفان", "الفين", "ألفين"],
    3000.0: ["ثلاثة آلاف", "ثلاثة الاف", "ثلاث الاف"],
    4000.0: ["أربعة آلاف", "اربعة الاف", "اربع الاف"],
    5000.0: ["خمسة آلاف", "خمسة الاف", "خمس الاف"],
    6000.0: ["ستة آلاف", "ستة الاف"],
    7000.0: ["سبعة آلاف", "سبعة الاف"],
    8000.0: ["ثمانية آلاف", "ثمانية الاف"],
    9000.0: ["تسعة آلاف", "تسعة الاف"],
    10000.0: ["عشرة آلاف", "عشرة الاف", "عشر الاف"],
    20000.0: ["عشرون ألف", "عشرين ألف", "عشرين الف"],
    50000.0: ["خمسون ألف", "خمسين ألف", "خمسين الف"],
    100000.0: ["مائة ألف", "مية ألف", "مئة الف"],
}

# Spellings of cities and states by their standard form (fixed values); the standard form maps to itself
CITIES = {"صنعاء": ["صنعا"], "عدن": [], "تعز": [], "الحديدة": ["حديدة"], "إب": ["اب"], "المكلا": ["مكلا"], "ذمار": [], "حجة": [], "عمران": [], "لحج": []}
STATUSES = {"مؤكد": ["موكد"], "قيد الانتظار": ["انتظار"], "قيد الشحن": ["شحن"], "تم التسليم": ["مسلم", "تم تسليمه"], "ملغي": ["ملغى"], "مرتجع": ["مسترجع"]}

# Currency words: those that mean Yemeni rials, and what is then removed; others by currency (fixed values)
RIAL_TRIGGERS = ["ريال", "YER"]
RIAL_PATTERN = r"(?U)(ريال\s*يمني|ريال|YER|yer)"
OTHER_CURRENCIES = {"USD": ["USD", "دولار"], "SAR": ["SAR", "سعودي"]}

# Texts that stand for no value (fixed values)
NO_AMOUNT = ["", "???", "????????", "null", "none", "nan", "N/A"]
NO_PAYMENT = ["", "null", "none", "???"]
NO_ID = ["", "null", "none", "nan"]
NO_EMAIL = ["@@", "@", "null", "none", "???"]
NO_ITEMS = ["", "null", "none", "not-json"]

# Date formats, tried in this order; single letters take one or two digits (fixed values)
DATE_FORMATS = [
    "yyyy-M-d'T'H:m:s", "yyyy-M-d H:m:s", "yyyy-M-d",
    "d-M-yyyy H:m:s", "d-M-yyyy",
    "d/M/yyyy H:m:s", "d/M/yyyy",
    "yyyy/M/d H:m:s", "yyyy/M/d",
]
FIRST_YEAR, LAST_YEAR = 2000, 2030

# Audit messages (fixed values)
SAY_DIGITS_AMOUNT = "Eastern/Arabic digits converted to Latin"
SAY_DIGITS_PHONE = "Arabic digits in phone converted to Latin"
SAY_DIGITS_DATE = "Converted Arabic digits in date"
SAY_CURRENCY = "Extracted currency text and normalized to YER"
SAY_COMMAS = "Thousands separator commas removed"
SAY_PHONE_YEMENI = "Normalized phone number format to standard 9-digit Yemeni number"
SAY_PHONE_PLAIN = "Stripped formatting from phone number"
SAY_EMAIL_AT = "Replaced repeated '@' symbols with a single '@'"
SAY_EMAIL_DOTS = "Replaced repeated dots with a single dot"
SAY_DATE = "Normalized date format to standard ISO 8601"
SAY_SPACE = "Trimmed extra whitespace"
