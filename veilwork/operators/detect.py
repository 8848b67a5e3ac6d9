"""Detectors: each gives the spans of one type in a block as an array, so that all detection is one narrow projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as K
from ..functions import constants as C
from ..functions import spans as S

FOUND = "array<struct<pii_type:string,s:int,e:int,v:string,score:double,source:string,name:string>>"


#: types whose values hold a digit: blocks without one skip their patterns
NUMERIC = ("SSN", "IPV4", "PAN", "AADHAAR", "PASSPORT", "GSTIN", "CIN", "IFSC", "PHONE", "CREDIT_CARD", "DOB")


@dataclass(frozen=True)
class Recognizer:
    """A detector: candidates(text) gives spans; score(span, text, low) their score, null to drop."""

    pii_type: str
    name: str
    source: str
    candidates: Callable[[Column], Column]
    score: Callable[[Column, Column, Column], Column]

    def column(self, text: Column, low: Column) -> Column:
        found = F.transform(self.candidates(text), lambda x: F.struct(F.lit(self.pii_type).alias("pii_type"), x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), self.score(x, text, low).cast("double").alias("score"), F.lit(self.source).alias("source"), F.lit(self.name).alias("name")))
        return F.filter(found, lambda x: x["score"].isNotNull()).cast(FOUND)


def _always(score: float) -> Callable:
    return lambda x, text, low: F.lit(score)


def _near(low: Column, x: Column, before: int, after: int, terms: Sequence[str]) -> Column:
    return S.has_any(S.around(low, x["s"], x["e"], before, after), terms)


def _code(name: str) -> Callable[[Column], Column]:
    return lambda t: S.find_all(t, rf"(?i)(?<![A-Z0-9]){C.CODES[name]}(?![A-Z0-9])")


def _address(text: Column) -> Column:
    """At most one span a block: from after an early colon, to a following label or the end."""
    return F.when(S.has_any(S.folded(text), C.ADDRESS_TERMS) & (F.char_length(text) <= 350), _address_in(text)).otherwise(F.array().cast(S.SPAN))


def _address_in(text: Column) -> Column:
    low = S.folded(text)
    terms = F.array(*[F.when(low.contains(t), F.lit(t)) for t in C.ADDRESS_TERMS])
    n = F.size(F.filter(terms, lambda x: x.isNotNull()))
    colon = F.instr(text, ":")
    rest = F.when((colon > 0) & (colon <= 80), F.substring(text, colon + 1, F.char_length(text))).otherwise(text)
    # white space goes from the start only where there was a colon
    trimmed = F.when((colon > 0) & (colon <= 80), F.regexp_replace(rest, r"^(?U)\s+", "")).otherwise(rest)
    s = F.char_length(text) - F.char_length(trimmed)
    body = F.regexp_replace(F.split(trimmed, "(?iU)" + C.ADDRESS_END, 2)[0], r"(?U)\s+$", "")
    ok = (n > 0) & ((n >= 2) | text.rlike("(?<![0-9])[1-9][0-9]{5}(?![0-9])")) & (F.char_length(text) <= 350) & (F.char_length(F.trim(body)) >= 12)
    span = F.struct(s.cast("int").alias("s"), (s + F.char_length(body)).cast("int").alias("e"), body.alias("v"))
    return F.when(ok, F.array(span)).otherwise(F.array().cast(S.SPAN))


def _phone(x: Column, text: Column, low: Column) -> Column:
    """International numbers and ten-digit Indian mobiles are valid; others need a context word; a rule of our own."""
    n, d = F.char_length(K.digits(x["v"])), K.digits(x["v"])
    valid = (x["v"].startswith("+") & n.between(8, 15)) | d.rlike("^[6-9][0-9]{9}$")
    score = F.when(valid, 0.95).when(n.between(7, 15) & _near(low, x, 35, 35, C.PHONE_CONTEXT), 0.72)
    return F.when(~_near(low, x, 35, 35, C.NOT_A_NUMBER), score)


def _named(text: Column) -> Column:
    """Names after a label; the label is no part of the span."""
    def cut(x: Column) -> Column:
        v = F.regexp_replace(x["v"], "^" + C.NAMED, "")
        return F.struct((x["e"] - F.char_length(v)).alias("s"), x["e"].alias("e"), v.alias("v"))
    return F.transform(S.find_all(text, C.NAMED + C.NAME, ":"), cut)


def _company(x: Column, labels: tuple[str, ...] = ()) -> Column:
    return ~S.normalized(x["v"]).isin(*C.PUBLIC_AUTHORITIES, *labels)


RECOGNIZERS = (
    Recognizer("EMAIL", "email", "PATTERN", lambda t: S.find_all(t, "(?U)" + C.EMAIL, "@"), _always(0.95)),
    Recognizer("SSN", "us_ssn", "PATTERN", lambda t: S.find_all(t, "(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"), lambda x, t, low: F.when(K.ssn(x["v"]), 0.95)),
    Recognizer("IPV4", "ipv4", "PATTERN", lambda t: S.find_all(t, r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])"), lambda x, t, low: F.when(K.ipv4(x["v"]), 0.95)),
    Recognizer("PAN", "india_pan", "PATTERN", _code("PAN"), _always(0.85)),
    Recognizer("AADHAAR", "aadhaar", "PATTERN", lambda t: S.find_all(t, "(?<![0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}(?![0-9])"), lambda x, t, low: F.when(K.verhoeff(x["v"]), 0.98).when(low.contains("aadhaar"), 0.70)),
    Recognizer("PASSPORT", "india_passport", "PATTERN", _code("PASSPORT"), lambda x, t, low: F.when(_near(low, x, 40, 40, ("passport",)), 0.93)),
    Recognizer("GSTIN", "gstin", "PATTERN", _code("GSTIN"), _always(0.85)),
    Recognizer("CIN", "cin", "PATTERN", _code("CIN"), _always(0.85)),
    Recognizer("IFSC", "ifsc", "PATTERN", _code("IFSC"), lambda x, t, low: F.when(_near(low, x, 60, 60, ("ifsc",)) & _near(low, x, 60, 60, C.BANK_CONTEXT), 0.93).otherwise(0.60)),
    Recognizer("PHONE", "phone_number", "VALIDATOR", lambda t: S.find_all(t, C.PHONE), _phone),
    Recognizer("CREDIT_CARD", "luhn_card", "VALIDATOR", lambda t: S.find_all(t, "(?<![0-9])(?:[0-9][ -]?){13,19}(?![0-9])"), lambda x, t, low: F.when(~_near(low, x, 40, 40, C.NOT_A_NUMBER) & K.luhn(x["v"]), 0.98)),
    Recognizer("DOB", "dob_context", "CONTEXT", lambda t: S.find_all(t, rf"(?i)(?<![0-9])(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{1,2}}\s+(?:{C.MONTHS})\s+[0-9]{{4}})(?![0-9])"), lambda x, t, low: F.when(_near(low, x, 55, 30, C.DOB_CONTEXT), 0.93)),
    Recognizer("COMPANY", "company_suffix", "GAZETTEER", lambda t: S.find_all(t, "(?U)" + C.COMPANY, "Limited|Ltd|LLP|Inc|Corp"), lambda x, t, low: F.when(_company(x), 0.93)),
    Recognizer("PERSON", "known_person", "GAZETTEER", lambda t: S.find_all(t, "(?i)" + "|".join(C.KNOWN_PERSONS), "(?i)hegde|shetty"), _always(0.93)),
    Recognizer("ADDRESS", "address_context", "CONTEXT", _address, _always(0.85)),
    Recognizer("PERSON", "named_person", "NER", _named, _always(0.82)),
    Recognizer("COMPANY", "organisation", "NER", lambda t: S.find_all(t, "(?U)" + C.COMPANY, "Limited|Ltd|LLP|Inc|Corp"), lambda x, t, low: F.when(_company(x, C.NO_COMPANIES), F.when(S.has_any(S.folded(x["v"]), C.COMMERCIAL), 0.85).otherwise(0.60))),
)


def detected(blocks: DataFrame, recognizers: Sequence[Recognizer] = RECOGNIZERS) -> DataFrame:
    """Blocks with `found`, the spans of all recognizers in their order; no row is moved."""
    text = F.col("text")
    rows = S.held(blocks.withColumns({"_low": S.folded(text), "_digit": text.rlike("[0-9]")}), "_low", "_digit")
    columns = [r.column(text, F.col("_low")) for r in recognizers]
    gated = [F.when(F.col("_digit"), c).otherwise(F.array().cast(FOUND)) if r.pii_type in NUMERIC else c for r, c in zip(recognizers, columns, strict=True)]
    return S.held(rows.withColumn("found", F.concat(*gated)).drop("_low", "_digit"), "found")


def detections(blocks: DataFrame, recognizers: Sequence[Recognizer] = RECOGNIZERS) -> DataFrame:
    """One row per span and recognizer: block_id, pii_type, start_offset, end_offset, value, score, source, recognizer, det_ord."""
    rows = detected(blocks, recognizers).select("block_id", F.posexplode("found").alias("det_ord", "x"))
    return rows.select("block_id", "x.pii_type", F.col("x.s").alias("start_offset"), F.col("x.e").alias("end_offset"), F.col("x.v").alias("value"), "x.score", "x.source", F.col("x.name").alias("recognizer"), "det_ord")
