"""Types, terms, names and patterns that results depend on."""

TYPES = ("PERSON", "EMAIL", "PHONE", "COMPANY", "ADDRESS", "SSN", "CREDIT_CARD", "DOB", "IPV4", "PAN", "AADHAAR", "PASSPORT", "GSTIN", "CIN", "IFSC", "PIN_CODE", "BIOMETRIC", "QR_CODE")
CORPORATE = ("COMPANY", "CIN", "GSTIN", "IFSC")
#: types that take the identity of a block's only person, or of its only company
PERSONAL_LINKS = ("EMAIL", "PHONE", "ADDRESS", "DOB", "PAN", "AADHAAR", "PASSPORT")
CORPORATE_LINKS = ("EMAIL", "PHONE", "ADDRESS", "CIN", "GSTIN", "IFSC")
#: types that reports list always, and their labels
REQUIRED = {"PERSON": "Full names", "EMAIL": "Email addresses", "PHONE": "Phone numbers", "COMPANY": "Company names", "ADDRESS": "Physical/mailing addresses", "SSN": "Social Security Numbers (SSNs)", "CREDIT_CARD": "Credit card numbers", "DOB": "Dates of birth", "IPV4": "IP addresses"}
#: overlap resolution: a higher number wins
PRIORITY = {"PAN": 100, "AADHAAR": 100, "PASSPORT": 100, "SSN": 100, "CREDIT_CARD": 100, "EMAIL": 95, "PHONE": 95, "IPV4": 95, "GSTIN": 90, "CIN": 90, "IFSC": 90, "DOB": 90, "ADDRESS": 80, "PERSON": 70, "COMPANY": 60, "PIN_CODE": 20, "BIOMETRIC": 100, "QR_CODE": 100}

PUBLIC_AUTHORITIES = ("securities and exchange board of india", "sebi", "government of india", "income tax department", "reserve bank of india", "rbi", "ministry of corporate affairs")
#: labels that a model takes for organisations
NO_COMPANIES = ("aadhaar", "address", "companies act", "credit card", "date of birth", "dob", "email", "inr", "ip", "ipv4", "pan", "phone", "ssn")
COMMERCIAL = ("limited", "ltd", "private", "pvt", "llp", "bank", "securities", "technologies", "industries", "enterprise", "company", "corporation", "consultants", "services", "capital", "registrar", "associates")
PHONE_CONTEXT = ("telephone", "phone", "mobile", "contact", "tel:", "fax")
ADDRESS_TERMS = ("address", "registered office", "corporate office", "road", "street", "lane", "nagar", "colony", "floor", "building", "plot", "district", "sector", "village")
NOT_A_NUMBER = ("order", "ticket", "invoice", "transaction", "reference", "registration", "employee id", "product id", "cin", "gstin", "folio", "application no", "version", "card-like")
DOB_CONTEXT = ("dob", "date of birth", "born on", "birth date")
BANK_CONTEXT = ("account", "bank account", "beneficiary", "bank details")
KNOWN_PERSONS = ("Kushal Subbayya Hegde", "Pushpa Kushal Hegde", "Rajesh Kushal Hegde", "Rohit Kushal Hegde", "Rakhi Girija Shetty", "Pushpa Hegde")

#: in the text of an image, signs of an identity document
IDENTITY_TERMS = ("date of birth", "dob", "permanent account number", "aadhaar", "unique identification", "father", "signature", "income tax", "government of india", "address")

MONTHS = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
EMAIL = r"\b[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\b"
COMPANY = r"\b[A-Z][A-Za-z0-9&.'()/-]*(?:\s+[A-Z][A-Za-z0-9&.'()/-]*){0,8}\s+(?:Private\s+Limited|Pvt\.?\s+Ltd\.?|Limited|Ltd\.?|LLP|Inc\.?|Corporation|Corp\.?)\b"
PHONE = r"\+?[0-9][0-9 ().-]{6,}[0-9]"
#: whole alphanumeric words of these shapes, case aside
CODES = {"PAN": "[A-Z]{5}[0-9]{4}[A-Z]", "PASSPORT": "[A-Z][0-9]{7}", "GSTIN": "[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z]Z[0-9A-Z]", "CIN": "[LU][0-9]{5}[A-Z]{2}[0-9]{4}[A-Z]{3}[0-9]{6}", "IFSC": "[A-Z]{4}0[A-Z0-9]{6}"}
NAMED = r"(?:Contact person|Name|Director|Promoter|Father's name|Father name)\s*:\s*"
NAME = r"[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}"
ADDRESS_END = r"(?:\s{2,}|[;|])(?:telephone|phone|mobile|e-mail|email|website|fax|contact(?:\s+person)?|cin|gstin)\s*:"
SUFFIX = r"\b(private\s+limited|pvt\.?\s+ltd\.?|limited|ltd\.?|llp|inc\.?|corp\.?)\b"

#: synthetic names of at most five letters, as only these are drawn
GIVEN = ("Aarav", "Arjun", "Diya", "Isha", "Kabir", "Kavya", "Meera", "Neel", "Nisha", "Priya", "Rahul", "Riya", "Rohan", "Tara", "Zoya")
SURNAMES = ("Desai", "Gupta", "Iyer", "Joshi", "Mehta", "Menon", "Nair", "Patel", "Rao", "Shah", "Singh", "Verma")
STEMS = ("Asteron", "Bluehaven", "Cedarfield", "Crestline", "Evermont", "Harborstone", "Lumenridge", "Meridian", "Northstar", "Oakbridge", "Silverleaf", "Westbrook")
DESCRIPTORS = ("Advisory", "Capital", "Engineering", "Industries", "Infrastructure", "Logistics", "Manufacturing", "Power", "Securities", "Systems", "Technologies", "Ventures")

ACTIONS = ("ADJUST_SPAN", "APPROVE", "CLEAR_MEDIA", "FORCE_MEDIA_REPLACEMENT", "IGNORE", "LINK_IDENTITY", "PROTECT", "REDACT", "REJECT_AS_NON_PII", "RETYPE", "UNLINK_IDENTITY")
AUTO, REVIEW = 0.85, 0.60

#: the controlled benchmark: text, then type and span of what it holds
BENCHMARK = (
    ("Contact person: John Smith", "PERSON", 16, 26),
    ("Email: reviewer.quality@example.test", "EMAIL", 7, 36),
    ("Telephone: +91 98765 43210", "PHONE", 11, 26),
    ("Address: 42 Example Road, Sample Nagar, Delhi 110001", "ADDRESS", 9, 52),
    ("Company: Example Technologies Private Limited", "COMPANY", 9, 45),
    ("Date of birth: 14/03/1987", "DOB", 15, 25),
    ("SSN: 123-45-6789", "SSN", 5, 16),
    ("Payment card: 4111 1111 1111 1111", "CREDIT_CARD", 14, 33),
    ("Client IP: 192.168.1.10", "IPV4", 11, 23),
    ("Board meeting held on December 10, 2025", None, None, None),
    ("Aggregate offer size is INR 7,100 million", None, None, None),
    ("Order 123456 remains open", None, None, None),
    ("See Page 124 for additional details", None, None, None),
    ("Offer Price and Floor Price are disclosed in this section", None, None, None),
    ("The Companies Act applies to the issuer", None, None, None),
    ("SEBI issued the applicable regulations", None, None, None),
    ("Revenue was INR 5,000,000 during the financial year", None, None, None),
    ("Reference identifier 123456789012345 remains unchanged", None, None, None),
    ("Version 999.12.4.1000 is not an IP address", None, None, None),
    ("Card-like value 4111 1111 1111 1112 fails validation", None, None, None),
    ("Registered office requirements are described by law", None, None, None),
)
#: further blocks for types that the tables lack
SAMPLES = (
    "Contact email: alpha@example.com PAN: ABCDE1234F DOB: 12/04/1998",
    "Holder abcde1234f and ABCDE1234FX, born on 5 march 1971 and 05-03-71",
    "Aadhaar 2943 6593 3461 and 2943-6593-3462 for Kushal Subbayya Hegde",
    "Passport A1234567 issued; code B7654321 is far from that word, it has nothing to do with it at all",
    "GSTIN 27ABCDE1234F1Z5, CIN U12345MH2001PLC123456 of Acme Trading Pvt. Ltd. here",
    "Bank account IFSC HDFC0001234 of the beneficiary; other word ABCD0XYZ123",
    "SSN 000-12-3456 or 666-12-3456 or 123-00-4567 but 219-09-9999 123-45-0000 457-55-5462",
    "Reserve Bank of India and Blue Sky Technologies Limited met Pushpa Hegde",
    "Registered Office: 7 Lake Street, 2nd floor, Pune 411001; Telephone: 022 4567 8901",
    "Mobile 98765 43210, order 9876543210, card 5500-0000-0000-0004 and 4111111111111111",
    "Host 10.0.0.1, 256.1.1.1, 01.2.3.4 and 8.8.8.8 answered pushpa kushal hegde",
)
