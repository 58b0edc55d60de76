"""Documented examples per rule, and properties every rule must have."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkveil.catalog.dictionaries import COMMON_WORDS, PRESETS
from inkveil.catalog.rules import FAST_NAME_RULES
from inkveil.functions.dialect import start_class
from inkveil.operators import scan as S
from inkveil.queries.registry import EVERY_RULE

RULES = {r.rule_id: r for r in EVERY_RULE}

# (rule, text, matches)
EXAMPLES = [
    ("B01", "12-34-56", ["12-34-56"]),
    ("B02", "12345678", ["12345678"]),
    ("B04", "Account: 1234567890", ["Account: 1234567890"]),
    ("B04", "Acct #: 98765432", ["Acct #: 98765432"]),
    ("B10", "$1,234.56", ["$1,234.56"]),
    ("B10", "-50.00", ["-50.00"]),
    ("B10", "£999,999.99", ["£999,999.99"]),
    ("B10", "1200.00 CR", ["200.00 CR"]),
    ("B10", "500.00 DR", ["500.00 DR"]),
    ("B10", "€1.234,56", ["€1", "234", "56"]),
    ("B11", "€1.234,56", ["€1.234,56"]),
    ("B05", "GB29NWBK60161331926819", ["GB29NWBK60161331926819"]),
    ("B06", "CHASUS33XXX", ["CHASUS33XXX"]),
    ("B12", "REF: ABC123XYZ", ["REF: ABC123XYZ"]),
    ("B12", "REFERENCE: ABC123XYZ", ["REFERENCE"]),
    ("B12", "Transaction #: TX987654", ["Transaction"]),
    ("B13", "Check #: 1001", ["Check #: 1001"]),
    ("M01", "MRN: A123456", ["MRN: A123456"]),
    ("M01", "Medical Record #: MR9876543", ["Medical Record #: MR9876543"]),
    ("M01", "Patient ID: P001234567", ["Patient ID: P001234567"]),
    ("M06", "A00.0", ["A00.0"]),
    ("M06", "Z99.89", ["Z99.89"]),
    ("M06", "J45.909", ["J45.909"]),
    ("M07", "CPT: 99213", ["CPT: 99213"]),
    ("M08", "92004", ["92004"]),
    ("M09", "ABC12-DE-3456", ["ABC12-DE-3456"]),
    ("M10", "123-45-6789A", ["123-45-6789A"]),
    ("I02", "Passport: AB1234567", ["Passport: AB1234567"]),
    ("I04", "123456789", ["123456789"]),
    ("I03", "N1234567", ["N1234567"]),
    ("I05", "N1234567", []),
    ("I06", "DL: A1234567", ["DL: A1234567"]),
    ("I08", "D1234-5678-9012", []),
    ("I11", "12/25/2023", ["12/25/2023"]),
    ("I12", "2023-12-25", ["2023-12-25"]),
    ("C08", "25/12/2023", ["25/12/2023"]),
    ("C06", "25/12/2023", []),
    ("I14", "90210", ["90210"]),
    ("I15", "M5V 3A8", ["M5V 3A8"]),
    ("I16", "SW1A 1AA", ["SW1A 1AA"]),
    ("E02", "Employee ID: ABC12345", ["Employee ID: ABC12345"]),
    ("E04", "EMP-98765", ["EMP-98765"]),
    ("E02", "Staff ID: 123456", ["Staff ID: 123456"]),
    ("E06", "$75,000/year", ["$75,000/year"]),
    ("E07", "Salary: $125,000.00", ["Salary: $125,000.00"]),
    ("E06", "$45.50 per hour", ["$45.50 per hour"]),
    ("E06", "$2,500/month", ["$2,500/month"]),
    ("E07", "Compensation: 95000", []),
    ("E09", "EIN: 12-3456789", ["EIN: 12-3456789"]),
    ("E09", "Tax ID: 98-7654321", ["Tax ID: 98-7654321"]),
    ("C01", "user+tag@example.com", ["user+tag@example.com"]),
    ("C01", "user@mail.company.co.uk", ["user@mail.company.co.uk"]),
    ("C02", "(555) 123-4567", ["555) 123-4567"]),
    ("C02", "+1-555-123-4567", ["1-555-123-4567"]),
    ("C03", "+44 20 1234 5678", ["44 20 1234 5678"]),
    ("C03", "+81 3-1234-5678", ["81 3-1234-5678"]),
    ("C11", "4111-1111-1111-1111", ["4111-1111-1111-1111"]),
    ("C11", "5500 0000 0000 0004", ["5500 0000 0000 0004"]),
    ("C11", "3400-000000-00009", []),
    ("C12", "3400-000000-00009", []),
    ("C12", "6011000000000004", ["6011000000000004"]),
    ("C09", "192.168.1.1", ["192.168.1.1"]),
    ("C09", "10.0.0.255", ["10.0.0.255"]),
    ("C09", "256.1.1.1", []),
    ("C10", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("C24", "00:1A:2B:3C:4D:5E", ["00:1A:2B:3C:4D:5E"]),
    ("C25", "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", ["1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa"]),
    ("C26", "1HGBH41JXMN109186", ["1HGBH41JXMN109186"]),
    ("C16", "https://example.com/path?query=value", ["https://example.com/path?query=value"]),
    ("C17", "a.b.com.12345 x", ["a.b.com"]),
    ("C17", "see a.bb..com or -x.org.", ["a.bb", "x.org"]),
    ("Q01", "Dr. Jane Mary Doe met", ["Jane Mary Doe"]),
    ("Q02", "Patient: Jane Doe", ["Jane Doe"]),
    ("Q02", "sent to the bank today now ok", ["the bank today now"]),
    ("Q03", "Smith, John A.", ["Smith"]),
    ("Q04", "Wood Lane House", ["Wood Lane House"]),
    ("L06", "12 Old\nOak Street, 14 x", ["12 Old\nOak Street"]),
    ("C04", "x é123456789 y", ["123456789"]),
    ("C13", "12345 é", ["12345"]),
    ("C22", "acct #: AB12345", ["acct #: AB12345"]),
]


def test_examples(spark):
    rows = [(i, rule, text) for i, (rule, text, _) in enumerate(EXAMPLES)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    used = [RULES[r] for r in sorted({r for r, _, _ in EXAMPLES})]
    found = {}
    for r in S.scan_rules(docs, used).orderBy("doc_id", "rule", "pos").collect():
        found.setdefault((r.doc_id, r.rule), []).append(r.match)
    wrong = [(rule, text, found.get((i, rule), []), want)
             for i, (rule, text, want) in enumerate(EXAMPLES) if found.get((i, rule), []) != want]
    assert not wrong


def _noise(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = ["12", "3", " ", "-", ".", "/", ":", "$", "€", "(", ")", "@", "a.b", "com", "Dr.", "To: ", "Case No. ", "AB",
             "ABCDEF", "Jo", "Anna", ",", "#", "é", "Ä", "1099", "W-2", "acct", "MEM", "street", " St", "ein", "http://x.",
             "January 5, 2020", "\n", "pay", "ref", "0", "19", "2023", "x_y", "_", "GRP-1"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(3, 30))) for _ in range(n)]


def test_matches_equal_plain_engine(spark):
    """Gates, look-aheads, boundary translation and stepping-over change no match."""
    texts = _noise(7, 300)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in S.scan_rules(docs, EVERY_RULE).orderBy("doc_id", "rule", "pos").collect():
        got.setdefault((r.doc_id, r.rule), []).append(r.match)
    for rule in EVERY_RULE:
        plain = re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.ignore_case else 0))
        for i, text in enumerate(texts):
            want = [m.group(rule.group) for m in plain.finditer(text)]
            assert got.get((i, rule.rule_id), []) == want, (rule.rule_id, text)


@pytest.mark.parametrize("text", [
    "Name: " + "ab " * 50_000, "a1." * 50_000 + "com", "1." * 50_000 + "c", "Dr. " + "Ab " * 50_000,
    "12 " * 50_000 + "x", "a-" * 50_000 + "@", "1,234" + ",567" * 50_000,
])
def test_long_runs_finish(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    risky = [RULES[r] for r in ("C01", "C17", "C21", "L06", "I13", "A01")] + list(FAST_NAME_RULES)
    assert S.scan_rules(docs, risky).count() >= 0


def test_start_class():
    assert start_class(r"\b\d{3}") == "0-9"
    assert start_class(r"\b(?:MRN|PATIENT\s*ID)x", True) == "MPmp"
    assert start_class(r"\b[A-Z]{2}\d") == "A-Z"
    assert start_class(r"-?\d") is None
    assert start_class(r"\b[A-Z]?\d") is None


def test_catalogue_counts():
    sizes = {k: (len(p.rules), len(p.keywords)) for k, p in PRESETS.items()}
    assert sizes == {
        "bank-statement": (14, 38), "medical-record": (15, 47), "legal-document": (7, 20), "employment": (15, 58),
        "identity": (17, 58), "financial": (6, 24), "insurance": (6, 20), "custom": (0, 0),
    }
    assert len(COMMON_WORDS) == 79
    assert len(RULES) == len(EVERY_RULE)


def test_streams_and_batches_share_gates(spark):
    docs = S.with_gates(spark.createDataFrame([(1, "X 9")], "doc_id long, text string"))
    assert docs.select("_low", "_digit").first() == ("x 9", True)
    assert S.drop_gates(docs).columns == ["doc_id", "text"]
    assert docs.select(F.size(S.rule_matches(RULES["F06"]))).first()[0] == 0


def test_absent_rules_are_told_before_they_run(spark):
    """The bit of a rule is set exactly where the rule finds nothing."""
    rules = {(r.pattern, r.ignore_case): r for r in EVERY_RULE}
    texts = [*_noise(11, 200), "SSN\u00a0123-45-6789", "Case\u2003No.\ufeff7", "12\u2028Old Oak Street", "", "12345 é"]
    docs = S.with_gates(spark.createDataFrame(list(enumerate(texts)), "i int, text string"))
    found = F.array(*[F.size(S.rule_matches(r, gated=False)) > 0 for r in rules.values()])
    for row in docs.select("text", "_absent", found.alias("found")).collect():
        for key, is_found in zip(rules, row.found):
            place = S._PLACES[key]
            assert row._absent[place // S._BITS] >> place % S._BITS & 1 == 1 - is_found, (key, row.text)


def test_absent_rules_of_odd_texts(spark):
    """Bytes that are no UTF-8 stay part of a match, and a null text has no matches."""
    docs = spark.sql("select 1 as doc_id, cast(unhex('687474703a2f2fff') as string) as text union all select 2, null")
    assert [(r.doc_id, r.rule) for r in S.scan_rules(docs, [RULES["A09"], RULES["C26"]]).collect()] == [(1, "A09")]
    assert S.count_rules(docs, (r for r in [RULES["A09"]])).first().n_matches == 1
    only_some = S.with_gates(spark.createDataFrame([("a@b.cd 12345",)], "text string"), rules=[RULES["A01"]])
    assert only_some.select(F.size(S.rule_matches(RULES["M08"]))).first()[0] == 1


# --- one walk for many words --------------------------------------------------------------------------


def test_words_in_finds_every_word(spark):
    rng = random.Random(4)
    word = lambda n, letters="abc-.": "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
    words = sorted({word(5) for _ in range(60)} | {"$", "#", "]", "^", "\\", "é", "£x"})
    texts = [word(200, "abc-.$#]^\\é£x ") for _ in range(50)] + [""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", S.words_in(F.col("t"), words).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert len(got[i]) == len(set(got[i])) and set(got[i]) == {w for w in words if w in t}


def windows_plainly(presets, text):
    low = "".join(c.lower() if c.isascii() else c for c in text)
    for name, keywords in presets:
        for k in keywords:
            starts = [i for i in range(len(text)) if low.startswith(k.lower(), i)]
            for n, i in enumerate(starts):
                yield name, k.lower(), n + 1, text[i : i + 100]


def test_keyword_windows_of_all_presets_in_one_walk(spark):
    rng = random.Random(5)
    keywords = [k for p in PRESETS.values() for k in p.keywords]
    texts = ["".join(rng.choice([*rng.sample(keywords, 3), "Tax ID", "é", ": x", "\n", " is "]) for _ in range(40)) for _ in range(20)]
    texts = [t.title() if i % 2 else t for i, t in enumerate(texts)] + ["", "ssnssn" * 300]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = S.scan_keyword_windows(docs, list(PRESETS)).collect()
    want = {(i, *w) for i, t in enumerate(texts) for w in windows_plainly([(n, p.keywords) for n, p in PRESETS.items()], t)}
    assert len(got) == len(want) and {(r.doc_id, r.preset, r.keyword, r.pos, r.window) for r in got} == want


def test_grouped_amounts_step_over_runs(spark):
    rule, rng = RULES["B11"], random.Random(6)
    texts = ["".join(rng.choice("1234.,,€ C") if rng.random() < 0.5 else rng.choice([".123", ",45", "12"]) for _ in range(30)) for _ in range(400)]
    texts += ["1.234.567,89", "1.2345,67", "123" + ".456" * 50_000, "1.234,5"]
    docs = S.with_gates(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"))
    got = {r.i: r.h for r in docs.select("i", S.rule_matches(rule).alias("h")).collect()}
    plain = re.compile(rule.pattern, re.ASCII)
    for i, t in enumerate(texts):
        if len(t) < 1000:
            assert got[i] == [m[0] for m in plain.finditer(t)], t
    assert got[402] == []
