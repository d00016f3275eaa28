"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust the score.

Kinds: email, ip (four decimal parts), card (Luhn), phone (international form) and iban (mod 97). A span's
score starts from how strong its validator is, rises with each context word of its kind within ``WINDOW``
characters and falls with each contrary word in those before it; a span under ``threshold`` is not redacted. Base spans (the first four kinds) always
come out of find_spans(); the threshold only decides about redaction.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import in_batches

KINDS = ("email", "ip", "card", "phone", "iban")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # as [0-9]+(\.[0-9]+){3}, in linear time
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
GROUP = re.compile(r"\x20?[A-Z0-9]{1,4}")
ALNUM = re.compile(r"[A-Za-z0-9]")
#: Length of an account number by country, as registered.
IBAN_LENGTH = {c: int(n) for part in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,DZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split() for n, cs in [part.split(":")] for c in cs.split(",")}
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"

WINDOW = 40
#: Score of a confirmed span without context, and the words that raise it, per kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.75, "phone": 0.7, "iban": 0.8}
CONTEXT = {
    "email": ("email", "mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer", "konto"),
}
RAISE = 0.1
#: Words before a span that speak against its kind, and what each takes off.
CONTRARY = {"ip": ("version", "release", "build", "section", "chapter"), "phone": ("isbn", "serial", "order"), "card": ("isbn", "ean", "serial", "order")}
LOWER = 0.2


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number in international form, without spaces."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _ip_ok(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))


def _card_ok(found: str) -> bool:
    digits = found.replace(" ", "").replace("-", "")
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone_ok(found: str) -> bool:
    return 10 <= sum("0" <= c <= "9" for c in found) <= 15


def _iban_ok(found: str) -> bool:
    code = found.replace(" ", "")
    return 15 <= len(code) <= 34 and mod97(code)


def _emails(text: str):
    """The matches of EMAIL, tried only from the start of the local part before each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ibans(text: str):
    """(start, end) of account numbers. Text that follows in capitals or digits is cut off: at the country's length, or for a
    country without one at the last group end that passes mod 97. A start that fails takes nothing with it."""
    done = 0
    for m in IBAN.finditer(text):
        if m.start() < done:
            continue
        ends, at = [], m.end()
        for _ in range(8):
            if not (g := GROUP.match(text, at)):
                break
            at = g.end()
            if not ALNUM.match(text, at):
                ends.append(at)
        length = IBAN_LENGTH.get(m[0][:2])
        exact = [e for e in ends if len(text[m.start() : e].replace(" ", "")) == length]
        for end in exact + (ends[-1:] if length else ends[::-1]):
            if _iban_ok(text[m.start() : end]):
                yield m.start(), end
                done = end
                break


def find_spans(text: str | None) -> list[Span]:
    """All confirmed spans, by start and then by kind as listed; offsets in code points, end exclusive.

    Matches of one kind don't overlap; spans of different kinds may. A match of a base kind that fails its
    validator is dropped and not tried in part. Null and empty texts have none.
    """
    if not text:
        return []
    found = [(*m.span(), "email") for m in _emails(text)]
    found += [(*m.span(), "ip") for m in IP.finditer(text) if _ip_ok(m[0])]
    found += [(*m.span(), "card") for m in CARD.finditer(text) if _card_ok(m[0])]
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if _phone_ok(m[0])]
    found += [(start, end, "iban") for start, end in _ibans(text)]
    spans = []
    for start, end, kind in found:
        before, after = (re.findall(r"[a-z]+", t.lower()) for t in (text[max(0, start - WINDOW) : start], text[end : end + WINDOW]))
        score = PRIOR[kind] + RAISE * sum(w in before or w in after for w in CONTEXT[kind]) - LOWER * sum(w in before for w in CONTRARY.get(kind, ()))
        spans.append(Span(start, end, kind, min(1.0, max(0.0, score))))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str | None, threshold: float = 0.6) -> str | None:
    """The text with a tag such as [EMAIL] for each span of at least that score; overlapping spans get the first one's tag. Null stays null."""
    if not text:
        return text
    out, done = [], 0
    for s in find_spans(text):
        if s.score >= threshold and s.end > done:
            if s.start >= done:
                out += [text[done : s.start], f"[{s.kind.upper()}]"]
            done = s.end
    return "".join(out) + text[done:]


def pii_report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the counts of base spans, the digest of base spans, all spans and the highest score."""

    def report(texts):
        out = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "max_score")}
        for t in texts:
            spans = find_spans(t)
            base = [s for s in spans if s.kind != "iban"]
            for kind in KINDS[:4]:
                out[f"n_{kind}"].append(sum(s.kind == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
            out["max_score"].append(max((s.score for s in spans), default=0.0))
        return out

    kind = docs.schema[id].dataType.simpleString()
    return in_batches(docs, [id, text], report, f"`{id}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, max_score double", passed=[id])


@F.udf(T.StringType(), useArrow=True)
def _redact(text, threshold):
    return redacted(text, threshold)


def redact(text: Column | str, threshold: float = 0.6) -> Column:
    return _redact(text, F.lit(threshold))
