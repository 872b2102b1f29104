"""Personal data in texts: regular expressions propose spans, checksums confirm them, nearby words adjust the score.

Kinds of the base rule, which always stay when confirmed: email, ip (parts up to 255), card (14 to 19 digits, Luhn),
phone (international, 10 to 15 digits). The method adds: iban (length by country form, mod 97 = 1), ssn and
phone_local; the last two have no checksum and need a telling word close by to reach the threshold.

Defined results: a null text is an empty one and has no spans; an empty table gives an empty result; repeated rows get
equal results; other columns, whatever their names, stay as they are. Texts are read whole: every pattern is linear in
the text, since possessive runs and look-behinds never try a run of digits or letters twice.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: In the order in which spans of equal start are listed.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "phone_local")
#: Code points before and after a span whose words count.
REACH = 48
THRESHOLD = 0.5

SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
SPANS_DDL = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits is taken whole whether or not the rest follows, so none is tried again from its middle.
_IP = re.compile(r"[0-9]++(\.[0-9]++\.[0-9]++\.[0-9]++)?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_GROUPED = re.compile(r"[0-9]++(?:(-[0-9]{2}-[0-9]{4})|([-.][0-9]{3}[-.][0-9]{4}))?")
_BRACKETED = re.compile(r"\([0-9]{3}\)\x20?[0-9]{3}[-.][0-9]{4}")
#: Characters of an account number by country; of other countries 15 to 34 are taken.
IBAN_SIZES = {
    c[:2]: int(c[2:])
    for c in """AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18
    FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27
    MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23
    ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30""".split()
}
_WORD = re.compile(r"[^\W\d_]+")
_TELLING = {
    "email": {"email", "mail", "contact", "write", "courriel", "correo"},
    "ip": {"ip", "address", "host", "server", "login"},
    "card": {"card", "visa", "credit", "payment", "carte", "tarjeta", "karte"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "telefon", "telefono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "phone_local": {"phone", "call", "tel", "mobile", "fax", "telefon", "telefono"},
}
#: Score without any telling word: what a checksum or strict form alone is worth.
_PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.9, "phone": 0.8, "iban": 0.9, "ssn": 0.3, "phone_local": 0.3}
_NEAR_BONUS = 0.4


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of ISO 7064 on an account number: rotated by four, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str):
    """Each @ with a local part before it and a dotted domain after it. Equal to scanning for the whole pattern from
    left to right, but linear: a run of local characters is followed back from its @ only."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the confirmed base kinds, sorted."""
    found = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if m[1] and all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(map(m[0].count, "0123456789")) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _alone(text: str, start: int, end: int, joins: str) -> bool:
    """No letter, digit or joining character stands directly before or after."""
    near = text[max(0, start - 1) : start] + text[end : end + 1]
    return not any(c.isalnum() or c in joins for c in near)


def _ibans(text: str):
    """Account numbers, each from its first place to the farthest end of a token that makes it valid: a proposal takes in
    capitals and digits that follow, and what makes it invalid may begin before the number or after it."""
    m = _IBAN.search(text)
    while m:
        start, at = m.start(), m.start() + 1
        size = IBAN_SIZES.get(text[start : start + 2])
        end = m.end() if _alone(text, start, m.end(), "") else text.rfind(" ", start, m.end())
        while end > start:
            code = text[start:end].replace(" ", "")
            if len(code) < (size or 15):
                break
            if len(code) <= (size or 34) and _alone(text, start, end, "") and mod97(code):
                yield start, end
                at = end
                break
            end = text.rfind(" ", start, end)
        m = _IBAN.search(text, at)


def _numbers(text: str):
    """Local numbers in groups: social security ones and phones."""
    for m in _GROUPED.finditer(text):
        if m.lastindex and m.end() - m.start() in (11, 12) and _alone(text, m.start(), m.end(), "-+("):
            if m[2]:
                yield m.start(), 6, m.end()
            elif m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield m.start(), 5, m.end()


def _more(text: str):
    """The added kinds, in rounds; spans of one round don't overlap."""
    yield [(a, 4, b) for a, b in _ibans(text)]
    yield list(_numbers(text))
    yield [(m.start(), 6, m.end()) for m in _BRACKETED.finditer(text) if _alone(text, m.start(), m.end(), "-+")]


def _covered(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what sorted spans cover."""
    starts, ends = [], []
    for a, _, b in found:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _score(text: str, start: int, kind: str, end: int) -> float:
    around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    near = any(w.lower() in _TELLING[kind] for w in _WORD.findall(around))
    return min(1.0, _PRIOR[kind] + _NEAR_BONUS * near)


def spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of one text: the base ones, and those of the added kinds that score enough and overlap no other."""
    text = text or ""
    base = base_spans(text)
    kept = list(base)
    for more in _more(text):
        starts, ends = _covered(kept)
        for a, k, b in more:
            last = bisect.bisect_left(starts, b) - 1  # of what begins before b, the farthest end
            if _score(text, a, KINDS[k], b) >= THRESHOLD and (last < 0 or ends[last] <= a):
                kept.append((a, k, b))
        kept.sort()
    return [(KINDS[k], a, b, _score(text, a, KINDS[k], b)) for a, k, b in kept]


def _listed(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _found(texts: pa.Array) -> pa.Array:
    names = ("kind", "start", "end", "score")
    return pa.array([[dict(zip(names, s)) for s in spans(t)] for t in texts.to_pylist()], pa.list_(SPAN))


_DIGEST = pa.struct([(f"n_{k}", pa.int64()) for k in KINDS[:4]] + [("base_sha256", pa.string()), ("spans", pa.string())])


DIGEST_DDL = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>"


def _digest(found: pa.Array) -> pa.Array:
    out = []
    for row in found.to_pylist():
        own = [(s["kind"], s["start"], s["end"]) for s in row]
        base = [s for s in own if s[0] in KINDS[:4]]
        n = {f"n_{k}": sum(s[0] == k for s in base) for k in KINDS[:4]}
        out.append(n | {"base_sha256": hashlib.sha256(_listed(base).encode()).hexdigest(), "spans": _listed(own)})
    return pa.array(out, _DIGEST)


def _masked(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts.to_pylist():
        if t is not None:
            parts, at = [], 0
            for kind, a, b, _ in spans(t):
                if a >= at:
                    parts += [t[at:a], f"[{kind.upper()}]"]
                at = max(at, b)
            t = "".join([*parts, t[at:]]) if parts else t
        out.append(t)
    return pa.array(out, pa.string())


def find_spans(text: Column | str) -> Column:
    """array of (kind, start, end, score) of a text column; code points, end exclusive."""
    return F.arrow_udf(_found, SPANS_DDL)(text)


def find(df: DataFrame, text: str = "text", to: str = "pii") -> DataFrame:
    """df with the spans of its text in column `to`."""
    return df.withColumn(to, find_spans(text))


def mask(df: DataFrame, text: str = "text") -> DataFrame:
    """df with each span of its text replaced by the span's kind in brackets; texts without spans, and nulls, stay."""
    return df.withColumn(text, F.arrow_udf(_masked, "string")(text))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return find(docs).select("doc_id", F.arrow_udf(_digest, DIGEST_DDL)("pii").alias("d")).select("doc_id", "d.*")
