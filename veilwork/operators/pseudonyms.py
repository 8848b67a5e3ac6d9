"""Replacement values from a keyed digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks as K
from ..functions import constants as C


def with_index(records: DataFrame, seed: bytes) -> DataFrame:
    """hmac-based index (1 to 9999) of each record's type and identity."""
    identity = F.coalesce("identity_id", "normalized_text")
    return records.withColumn("index", K.number(K.hmac(seed, F.concat_ws("|", "pii_type", identity)), 0, 8) % 9999 + 1)


def _pick(names: Sequence[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))


def with_profile(records: DataFrame, seed: bytes) -> DataFrame:
    """given, surname, stem, descriptor and number of each record's identity."""
    h = K.hmac(seed, F.coalesce("identity_id", "record_id"))
    rows = records.withColumn("_h", h)
    part = lambda k, n: K.number(F.col("_h"), 2 * k, 2 * n)
    return rows.withColumns({"given": _pick(C.GIVEN, part(0, 2)), "surname": _pick(C.SURNAMES, part(2, 2)), "stem": _pick(C.STEMS, part(4, 2)), "descriptor": _pick(C.DESCRIPTORS, part(6, 2)), "number": part(8, 4) % 100000}).drop("_h")


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def mask() -> Column:
    return F.concat(F.lit("["), F.col("pii_type"), F.lit("_"), _padded(F.col("index"), 4), F.lit("]"))


def partial() -> Column:
    """The last four letters or digits stay, or an address's first letter and domain, or half an IP address."""
    v, t = F.col("original_text"), F.col("pii_type")
    tail = F.right(F.regexp_replace(v, "[^A-Za-z0-9]", ""), F.lit(4))
    stars = F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(4), F.char_length(v) - F.char_length(tail))), tail)
    local = F.substring_index(v, "@", 1)
    mail = F.concat(F.when(local == "", "x").otherwise(F.substring(local, 1, 1)), F.lit("***@"), F.substring(v, F.char_length(local) + 2, F.char_length(v)))
    return F.when(t.isin("PHONE", "AADHAAR", "PAN", "CREDIT_CARD"), stars).when((t == "EMAIL") & v.contains("@"), mail).when(t == "IPV4", F.concat(F.substring_index(v, ".", 2), F.lit(".x.x"))).otherwise(mask())


def card() -> Column:
    """A test-range number of the same length that passes Luhn, poured into the original's separators."""
    v = F.col("original_text")
    n = F.least(F.lit(19), F.greatest(F.lit(13), F.char_length(K.digits(v))))
    body = F.substring(F.concat(F.lit("411111"), _padded(F.col("index"), 12)), F.lit(1), n - 1)
    full = F.concat(body, K.luhn_digit(body))
    chars = F.filter(F.split(v, ""), lambda x: x != "")
    start = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    step = lambda a, c: F.struct((a["k"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("k"), F.concat(a["out"], F.when(c.rlike("[0-9]"), F.substring(full, a["k"], F.lit(1))).otherwise(c)).alias("out"))
    return F.aggregate(chars, start, step, lambda a: a["out"])


def birthday() -> Column:
    v, day = F.col("original_text"), F.date_add(F.lit("1900-01-01").cast("date"), (F.col("index") % 365).cast("int"))
    return F.when(v.rlike("^[0-9]{1,2}/[0-9]{1,2}/[0-9]{2,4}$"), F.date_format(day, "dd/MM/yyyy")).when(v.rlike("^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2,4}$"), F.date_format(day, "dd-MM-yyyy")).otherwise(F.date_format(day, "dd MMMM yyyy"))


def synthetic() -> Column:
    """A value of the same kind that belongs to nobody; needs with_index and with_profile."""
    i, t, v = F.col("index"), F.col("pii_type"), F.col("original_text")
    num = _padded(F.col("number"), 5)
    suffix = F.regexp_extract(v, "(?i)" + C.SUFFIX, 1)
    twelve = F.concat(F.lit("00000000"), _padded(i % 10000, 4))
    other = F.concat(F.substring(twelve, 1, 11), ((F.substring(twelve, 12, 1).cast("int") + 1) % 10).cast("string"))
    aadhaar = F.when(K.verhoeff(twelve), other).otherwise(twelve)
    cases = {
        "PERSON": F.concat_ws(" ", "given", "surname"),
        "EMAIL": F.concat(F.lower("given"), F.lit("."), F.lower("surname"), F.lit("."), num, F.lit("@example.test")),
        "PHONE": F.concat(F.lit("+91 00000 "), num),
        "ADDRESS": F.concat((F.col("number") % 199 + 1).cast("string"), F.lit(" Sample Road, Test City 000001")),
        "COMPANY": F.concat(F.col("stem"), F.lit(" "), F.col("descriptor"), F.lit(" "), _padded(i, 4), F.lit(" "), F.when(suffix == "", "Private Limited").otherwise(suffix)),
        "DOB": birthday(),
        "IPV4": F.concat(F.lit("198.51.100."), (i % 253 + 1).cast("string")),
        "SSN": F.concat(F.lit("000-00-"), _padded(i % 10000, 4)),
        "CREDIT_CARD": card(),
        "PAN": F.concat(F.lit("TESTX"), _padded(i % 10000, 4), F.lit("Z")),
        "AADHAAR": F.concat_ws(" ", F.substring(aadhaar, 1, 4), F.substring(aadhaar, 5, 4), F.substring(aadhaar, 9, 4)),
        "PASSPORT": F.concat(F.lit("Z"), _padded(i % 10000000, 7)),
        "GSTIN": F.concat(F.lit("00TESTX"), _padded(i % 10000, 4), F.lit("Z0Z0")),
        "CIN": F.concat(F.lit("U00000ZZ1900ZZZ"), _padded(i % 1000000, 6)),
        "IFSC": F.concat(F.lit("TEST9"), _padded(i % 1000000, 6)),
    }
    out = mask()
    for kind, value in cases.items():
        out = F.when(t == kind, value).otherwise(out)
    return out


MODES = {"mask": mask, "partial": partial, "synthetic": synthetic}


def with_value(records: DataFrame, seed: bytes, mode: str = "synthetic") -> DataFrame:
    """Each record's own replacement; one that contains its original, or the reverse, becomes a mask."""
    rows = with_profile(with_index(records, seed), seed).withColumn("_v", MODES[mode]())
    a, b = F.lower("_v"), F.lower("original_text")
    return rows.withColumn("value", F.when(F.contains(a, b) | F.contains(b, a), mask()).otherwise(F.col("_v"))).drop("_v")


def with_replacement(records: DataFrame, seed: bytes, mode: str = "synthetic") -> DataFrame:
    """replacement_value of records to redact: that of the first such record with the same type and normalized text."""
    # other records stand alone, so that their values are not sorted together
    alike = F.when(F.col("policy_action") == "REDACT", F.col("normalized_text")).otherwise(F.col("record_id"))
    by = Window.partitionBy("pii_type", alike, "policy_action").orderBy("document_part", "block_id", "start_offset", "pii_type")
    rows = with_value(records, seed, mode)
    return rows.withColumn("replacement_value", F.when(F.col("policy_action") == "REDACT", F.first("value").over(by))).drop("value", "given", "surname", "stem", "descriptor", "number", "index")
