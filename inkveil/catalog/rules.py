"""The detection rules: one row per pattern.

``hints`` and ``digit`` are necessary conditions of a match (any hint occurs in the lower-cased text;
some digit occurs). The scan tests them first, so a text without them never meets the regex. They may
only ever be wider than the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    rule_id: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    soft: str = ""
    digit: bool = False
    hints: tuple[str, ...] = ()
    kind: str = "pattern"
    # the pattern ends in an unbounded word run; Java may take that run without recursion
    open_run: bool = False
    # Java only: an equivalent of the pattern that loops where the plain one would recurse per repetition
    java: str | None = None
    # Java only: text to step over when the pattern fails here, because it would then fail at every later
    # start inside that text too. Keeps long runs linear; both sides see the same matches.
    barren: str | None = None
    # body of a class with every character a match can begin with, where the pattern does not tell
    first: str | None = None


# Patterns that must find exactly what the reference finds. Shapes used by several
# rules are named once.
SSN = r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"
CARD_4X4 = r"\b(?:\d{4}[-\s]?){3}\d{4}\b"
ZIP_US = r"\b\d{5}(?:-\d{4})?\b"
POSTCODE_CA = r"\b[A-Z]\d[A-Z]\s?\d[A-Z]\d\b"
POSTCODE_UK = r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s?\d[A-Z]{2}\b"
PHONE_PLAIN = r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
DATE_MDY = r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)?\d{2}\b"
DATE_YMD = r"\b(?:19|20)\d{2}[/-](?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])\b"
DATE_LOOSE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
DOLLARS_LOOSE = r"\$[\d,]+\.?\d*"

# Digits in groups, as many as there are, with no decimal comma behind: a match that begins inside could only go on
# through that end. Where a further digit follows, one may begin in the last group.
_GROUPED_RUN = r"\d++(?:\.\d{3})*+(?!\d|,\d{2})"
_MAIL_RUN = r"\b[A-Za-z0-9][\w.%+-]*+"
_STREET_RUN = r"\d++\s++[\w\s]*+"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\."
# From one place where a top-level domain may end the match to the next, as often as possible.
_DOMAIN_LOOP = (
    rf"\b(?:(?:{_LABEL}(?![a-z]{{2,6}}\b))*+{_LABEL}(?=[a-z]{{2,6}}\b))++[a-z]{{2,6}}\b"
)

# Always-on rules.
COMMON_RULES = (
    Rule("C01", r"\b[A-Za-z0-9][\w.%+-]*@[A-Za-z0-9][\w.-]*\.[A-Za-z]{2,}\b", hints=("@",), barren=_MAIL_RUN),
    Rule("C02", r"\b(?:\+?1[-.\s]?)?\(?(?:[2-9]\d{2})\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", soft="L", digit=True, first="+(0-9"),
    Rule("C03", r"\b\+?\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}\b", soft="L", digit=True, first="+0-9"),
    Rule("C04", SSN, digit=True),
    Rule("C05", r"\b(?:SSN|SOCIAL\s*SECURITY|SOC\s*SEC)[\s:#]*(?:\d{3}[-\s]?\d{2}[-\s]?\d{4})\b",
         ignore_case=True, digit=True, hints=("ssn", "soc")),
    Rule("C06", DATE_MDY, digit=True),
    Rule("C07", DATE_YMD, digit=True),
    Rule("C08", r"\b(?:0?[1-9]|[12]\d|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)\d{2}\b", digit=True),
    Rule("C09", r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)\b",
         digit=True),
    Rule("C10", r"\b(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}\b", hints=(":",)),
    Rule("C11", CARD_4X4, digit=True),
    Rule("C12", r"\b(?:3[47]\d{13}|4\d{15}|5[1-5]\d{14}|6(?:011|5\d{2})\d{12})\b", digit=True),
    Rule("C13", ZIP_US, digit=True),
    Rule("C14", POSTCODE_CA, digit=True),
    Rule("C15", POSTCODE_UK, digit=True),
    Rule("C16", r"https?://(?:www\.)?[-\w@:%.+~#=]{1,256}\.[a-z]{2,6}\b(?:[-\w@:%+.~#?&/=]*)",
         ignore_case=True, hints=("http",)),
    Rule("C17", r"\b(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,6}\b", ignore_case=True, hints=(".",),
         java=_DOMAIN_LOOP, barren=rf"\b(?:{_LABEL})++"),
    Rule("C18", r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b", digit=True, hints=("$",)),
    Rule("C19", r"£\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b", digit=True, hints=("£",)),
    Rule("C20", r"€\s?\d{1,3}(?:[.,]\d{3})*(?:[.,]\d{2})?\b", digit=True, hints=("€",)),
    Rule("C21", r"(?:[£$€¥]\s?)?-?\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?(?:\s?(?:USD|GBP|EUR|JPY|CAD|AUD))?\b",
         digit=True),
    Rule("C22", r"\b(?:account|acct\.?|acc|a/c)[\s#:]*(?:[A-Z0-9]{6,20})\b", ignore_case=True,
         hints=("acc", "a/c")),
    Rule("C23", r"\b(?:routing|aba|rtn)[\s#:]*(?:\d{9})\b", ignore_case=True, digit=True,
         hints=("routing", "aba", "rtn")),
    Rule("C24", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", hints=(":", "-")),
    Rule("C25", r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b", digit=True),
    Rule("C26", r"\b[A-HJ-NPR-Z0-9]{17}\b"),
    Rule("C27", r"\b[A-Z]{1,3}[-\s]?\d{1,4}[-\s]?[A-Z]{0,2}\b", soft="R", digit=True),
)

# Name rules of the pattern scan.
NAME_RULES = (
    Rule("Q01", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Dr\.?|Prof\.?|Rev\.?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2})\b",
         group=1, hints=("mr", "ms", "miss", "dr", "prof", "rev")),
    Rule("Q02", r"\b(?:name|patient|client|customer|employee|applicant|defendant|plaintiff|author|contact|attn"
                r"|attention|from|to|by|signed)[\s:]+([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b",
         ignore_case=True, group=1,
         hints=("to", "by", "from", "name", "patient", "client", "customer", "employee", "applicant", "defendant",
                "plaintiff", "author", "contact", "attn", "attention", "signed")),
    Rule("Q03", r"\b([A-Z][a-z]+),\s+([A-Z][a-z]+(?:\s+[A-Z]\.?)?)\b", group=1, soft="R", hints=(",",)),
    Rule("Q04", r"\b([A-Z][a-z]{2,15}\s+[A-Z][a-z]{2,15}(?:\s+[A-Z][a-z]{2,15})?)\b", group=1),
)

# Preset rules.
BANK_RULES = (
    Rule("B01", r"\b\d{2}-\d{2}-\d{2}\b", digit=True),
    Rule("B02", r"\b\d{8}\b", digit=True),
    Rule("B03", r"\b\d{9}\b", digit=True),
    Rule("B04", r"\b(?:account|acct\.?|acc)[\s:#]*(?:\d{8,17})\b", ignore_case=True, digit=True, hints=("acc",)),
    Rule("B05", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", digit=True),
    Rule("B06", r"\b[A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b"),
    Rule("B07", CARD_4X4, digit=True),
    Rule("B08", r"\b\d{13,19}\b", digit=True),
    Rule("B09", r"\b\d{3}-\d{3}\b", digit=True),
    Rule("B10", r"(?:[£$€¥]\s?)?-?\d{1,3}(?:[,\s]\d{3})*(?:\.\d{2})?(?:\s?(?:CR|DR|USD|GBP|EUR|JPY))?\b", digit=True),
    Rule("B11", r"(?:[£$€¥]\s?)?\d{1,3}(?:\.\d{3})*(?:,\d{2})(?:\s?(?:CR|DR|USD|GBP|EUR|JPY))?\b", digit=True,
         barren=_GROUPED_RUN),
    Rule("B12", r"\b(?:REF|REFERENCE|TXN|TRANS)[\s:#]*(?:[A-Z0-9]{6,20})\b", ignore_case=True,
         hints=("ref", "txn", "trans")),
    Rule("B13", r"\b(?:CHECK|CHEQUE|CHK)[\s:#]*(?:\d{3,8})\b", ignore_case=True, digit=True,
         hints=("check", "cheque", "chk")),
    Rule("B14", r"\b(?:WIRE|FED|FEDWIRE)[\s:#]*(?:[A-Z0-9]{8,20})\b", ignore_case=True, hints=("wire", "fed")),
)

MEDICAL_RULES = (
    Rule("M01", r"\b(?:MRN|MEDICAL\s*RECORD|PATIENT\s*ID)[\s:#]*(?:[A-Z0-9]{6,12})\b", ignore_case=True,
         hints=("mrn", "medical", "patient")),
    Rule("M02", r"\b[A-Z]{1,3}\d{6,10}\b", digit=True),
    Rule("M03", r"\b(?:NPI)[\s:#]*(?:\d{10})\b", ignore_case=True, digit=True, hints=("npi",)),
    Rule("M04", r"\b\d{10}\b", digit=True),
    Rule("M05", r"\b[A-Z]{2}\d{7}\b", digit=True),
    Rule("M06", r"\b[A-TV-Z]\d{2}\.?\d{0,4}\b", soft="R", digit=True),
    Rule("M07", r"\b(?:CPT)[\s:#]*(?:\d{5})\b", ignore_case=True, digit=True, hints=("cpt",)),
    Rule("M08", r"\b\d{5}\b", digit=True),
    Rule("M09", r"\b[A-Z]{1,3}\d{2}-[A-Z]{2}-\d{4}\b", digit=True),
    Rule("M10", r"\b\d{3}-\d{2}-\d{4}[A-Z]?\b", digit=True),
    Rule("M11", r"\b(?:POLICY|MEMBER|SUBSCRIBER)[\s:#]*(?:[A-Z0-9]{6,20})\b", ignore_case=True,
         hints=("policy", "member", "subscriber")),
    Rule("M12", r"\b(?:RX|PRESCRIPTION)[\s:#]*(?:[A-Z0-9]{6,15})\b", ignore_case=True, hints=("rx", "prescription")),
    Rule("M13", PHONE_PLAIN, soft="L", digit=True, first="(0-9"),
    Rule("M14", DATE_MDY, digit=True),
    Rule("M15", DATE_YMD, digit=True),
)

LEGAL_RULES = (
    Rule("L01", r"\b\d{1,4}[-:]\w{2,4}[-:]\d{4,8}\b", digit=True),
    Rule("L02", r"\bCase\s*(?:No\.?|#)\s*[\w-]+", ignore_case=True, hints=("case",)),
    Rule("L03", r"\bBar\s*(?:No\.?|#)\s*\d+", ignore_case=True, digit=True, hints=("bar",)),
    Rule("L04", r"\bDocket\s*(?:No\.?|#)\s*[\w-]+", ignore_case=True, hints=("docket",)),
    Rule("L05", DATE_LOOSE, digit=True),
    Rule("L06", r"\d+\s+[\w\s]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct)\.?",
         ignore_case=True, digit=True, barren=_STREET_RUN,
         hints=("st", "av", "road", "rd", "boulevard", "blvd", "dr", "lane", "ln", "court", "ct")),
    Rule("L07", ZIP_US, digit=True),
)

EMPLOYMENT_RULES = (
    Rule("E01", SSN, digit=True),
    Rule("E02", r"\b(?:EMPLOYEE\s*ID|EMP\s*ID|STAFF\s*ID|PERSONNEL)[\s:#]*(?:[A-Z0-9]{4,12})\b", ignore_case=True,
         hints=("emp", "staff", "personnel")),
    Rule("E03", r"\b[A-Z]{1,3}\d{4,8}\b", digit=True),
    Rule("E04", r"\bEMP[-\s]?\d{4,8}\b", ignore_case=True, digit=True, hints=("emp",)),
    Rule("E05", r"\b\d{6,8}\b", digit=True),
    Rule("E06", r"\$\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?"
                r"(?:\s*(?:per|/)\s*(?:year|annum|yr|month|mo|hour|hr|week|wk|bi-?weekly))?\b",
         ignore_case=True, digit=True, hints=("$",)),
    Rule("E07", r"(?:salary|compensation|pay|wage)[\s:]*\$?\s?\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b", ignore_case=True,
         digit=True, hints=("salary", "compensation", "pay", "wage")),
    Rule("E08", r"\b(?:ACCOUNT|ACCT|DIRECT\s*DEPOSIT)[\s:#]*(?:\d{8,17})\b", ignore_case=True, digit=True,
         hints=("acc", "direct")),
    Rule("E09", r"\b(?:EIN|TAX\s*ID)[\s:#]*(?:\d{2}-\d{7})\b", ignore_case=True, digit=True, hints=("ein", "tax")),
    Rule("E10", r"\b\d{2}-\d{7}\b", digit=True),
    Rule("E11", r"\b(?:RATING|SCORE|PERFORMANCE)[\s:#]*(?:\d+(?:\.\d+)?(?:\s*/\s*\d+)?)\b", ignore_case=True,
         digit=True, hints=("rating", "score", "performance")),
    Rule("E12", PHONE_PLAIN, soft="L", digit=True, first="(0-9"),
    Rule("E13", r"\b(?:EMERGENCY|CONTACT)[\s:]+(?:[A-Z][a-z]+\s+[A-Z][a-z]+)\b", ignore_case=True,
         hints=("emergency", "contact")),
    Rule("E14", r"\b(?:HIRE|START|TERMINATION|REVIEW)\s*(?:DATE)?[\s:#]*(?:[\d/-]+)\b", ignore_case=True, soft="R",
         hints=("hire", "start", "termination", "review")),
    Rule("E15", DATE_MDY, digit=True),
)

IDENTITY_RULES = (
    Rule("I01", SSN, digit=True),
    Rule("I02", r"\b(?:PASSPORT|PASS)[\s:#]*(?:[A-Z0-9]{6,12})\b", ignore_case=True, hints=("pass",)),
    Rule("I03", r"\b[A-Z]{1,2}\d{6,9}\b", digit=True),
    Rule("I04", r"\b\d{9}\b", digit=True),
    Rule("I05", r"\b[A-Z]\d{8}\b", digit=True),
    Rule("I06", r"\b(?:DL|LICENSE|LICENCE|DRIVER)[\s:#]*(?:[A-Z0-9]{6,20})\b", ignore_case=True,
         hints=("dl", "licen", "driver")),
    Rule("I07", r"\b[A-Z]\d{7,14}\b", digit=True),
    Rule("I08", r"\b\d{1,3}[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{3,4}\b", digit=True),
    Rule("I09", r"\b(?:NATIONAL\s*ID|ID\s*NUMBER|IDENTITY)[\s:#]*(?:[A-Z0-9]{6,20})\b", ignore_case=True,
         hints=("national", "id")),
    Rule("I10", r"\b(?:DOB|DATE\s*OF\s*BIRTH)[\s:#]*(?:[\d/-]+)\b", ignore_case=True, soft="R", hints=("dob", "date")),
    Rule("I11", r"\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12]\d|3[01])[/-](?:19|20)\d{2}\b", digit=True),
    Rule("I12", DATE_YMD, digit=True),
    Rule("I13", r"\b\d+\s+[\w\s]+(?:Street|St\.|Avenue|Ave\.|Road|Rd\.|Boulevard|Blvd\.|Drive|Dr\.|Lane|Ln\.|Court"
                r"|Ct\.|Way|Place|Pl\.)(?:[\s,]+[\w\s]+)?\b", ignore_case=True, soft="R", digit=True, barren=r"\b" + _STREET_RUN,
         hints=("st", "av", "road", "rd.", "boulevard", "blvd", "dr", "lane", "ln.", "court", "ct.", "way", "pl")),
    Rule("I14", ZIP_US, digit=True),
    Rule("I15", POSTCODE_CA, digit=True),
    Rule("I16", POSTCODE_UK, digit=True),
    Rule("I17", r"\b(?:VISA)[\s:#]*(?:[A-Z0-9]{8,12})\b", ignore_case=True, hints=("visa",)),
)

FINANCIAL_RULES = (
    Rule("F01", SSN, digit=True),
    Rule("F02", r"\b\d{2}[-\s]?\d{7}\b", digit=True),
    Rule("F03", r"\b\d{8,17}\b", digit=True),
    Rule("F04", DOLLARS_LOOSE, hints=("$",)),
    Rule("F05", r"\b1099[-\s]?[A-Z]{1,4}\b", ignore_case=True, digit=True, hints=("1099",)),
    Rule("F06", r"\bW[-\s]?[249]\b", ignore_case=True, digit=True),
)

INSURANCE_RULES = (
    Rule("N01", r"\b[A-Z]{2,4}[-\s]?\d{6,12}\b", digit=True),
    Rule("N02", r"\b(?:CLM|CLAIM)[-\s]?\d+", ignore_case=True, digit=True, hints=("clm", "claim")),
    Rule("N03", r"\b(?:GRP|GROUP)[-\s]?\d+", ignore_case=True, digit=True, hints=("grp", "group")),
    Rule("N04", r"\b(?:MEM|MEMBER)[-\s]?\d+", ignore_case=True, digit=True, hints=("mem",)),
    Rule("N05", DATE_LOOSE, digit=True),
    Rule("N06", DOLLARS_LOOSE, hints=("$",)),
)

# Rules of the fast scan; ``kind`` is the entity type they report.
_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
_EMAIL_RUN = r"\b[A-Za-z0-9._%+-]++"
_PHONE_US = r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
_DATE_ANY = (
    r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{2}[-/]\d{2}"
    r"|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{1,2},?\s+\d{4})\b"
)
_STREET = (
    r"\b\d{1,5}\s+(?:[A-Za-z]+\s+){1,4}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct"
    r"|Way|Place|Pl|Circle|Cir)\.?\b"
)
_IPV4_LOOSE = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_DOLLARS = r"\$[\d,]+(?:\.\d{2})?\b"

FAST_RULES = (
    Rule("A01", _EMAIL, soft="LR", hints=("@",), kind="emails", barren=_EMAIL_RUN),
    Rule("A02", _PHONE_US, soft="L", digit=True, first="+(0-9", kind="phones"),
    Rule("A03", SSN, digit=True, kind="ssn"),
    Rule("A04", CARD_4X4, digit=True, kind="creditCards"),
    Rule("A05", _DATE_ANY, ignore_case=True, digit=True, kind="dates"),
    Rule("A06", _STREET, ignore_case=True, soft="R", digit=True, kind="addresses"),
    Rule("A07", ZIP_US, digit=True, kind="zipCodes"),
    Rule("A08", _IPV4_LOOSE, digit=True, kind="ipAddresses"),
    Rule("A09", r"""https?://[^\s<>"{}|\\^`\[\]]+""", hints=("http",), kind="urls"),
    Rule("A10", r"\b(?:acct?\.?|account|id|#)\s*:?\s*[A-Z0-9]{4,20}\b", ignore_case=True, soft="L",
         hints=("acc", "id", "#"), kind="accountNumbers"),
    Rule("A11", _DOLLARS + r"|\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s*(?:dollars?|USD)\b", ignore_case=True, soft="R",
         hints=("$", "dollar", "usd"), kind="currency"),
)

FAST_NAME_RULES = (
    Rule("H01", r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Dr\.?|Prof\.?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)", group=1,
         hints=("mr", "ms", "dr", "prof"), kind="name", open_run=True),
    Rule("H02", r"\b(?:name|patient|client|customer|employee|applicant|defendant|plaintiff):"
                r"\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", ignore_case=True, group=1,
         hints=("name:", "patient:", "client:", "customer:", "employee:", "applicant:", "defendant:", "plaintiff:"),
         kind="name", open_run=True),
    Rule("H03", r"\b(?:signed|by|from|to|attn|attention):\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)", ignore_case=True,
         group=1, hints=("signed:", "by:", "from:", "to:", "attn:", "attention:"), kind="name", open_run=True),
)

# Rules of the deep scan.
DEEP_RULES = (
    Rule("D01", _EMAIL, soft="LR", hints=("@",), barren=_EMAIL_RUN),
    Rule("D02", _PHONE_US, soft="L", digit=True, first="+(0-9"),
    Rule("D03", SSN, digit=True),
    Rule("D04", CARD_4X4, digit=True),
    Rule("D05", _DATE_ANY, ignore_case=True, digit=True),
    Rule("D06", _STREET, ignore_case=True, soft="R", digit=True),
    Rule("D07", ZIP_US, digit=True),
    Rule("D08", _IPV4_LOOSE, digit=True),
    Rule("D09", _DOLLARS, soft="R", hints=("$",)),
)

# Rules of the superseded first version, kept for comparison runs.
LEGACY_RULES = (
    Rule("Z01", r"\b[\w.-]+@[\w.-]+\.\w{2,4}\b", soft="L", hints=("@",), kind="emails", barren=r"\b[\w.-]++"),
    Rule("Z02", r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", digit=True, kind="phones"),
)
