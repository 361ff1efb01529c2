"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors in a text: at-signs, plus signs, digits, URL schemes and words that
announce an account or a key. At each anchor a local parser expands to the span's boundaries and validates it; no
pattern is searched over the text. Positions are code points, ends exclusive.

Base kinds (leftmost, non-overlapping per kind; what fails validation is dropped, not retried): email, ip, card,
phone. Added kinds: url (scheme, host, path, without closing punctuation), account (the identifier behind a cue such
as `iban` or `account`, of 8 characters or more with two digits at least), secret (a value of 16 characters or more
behind a cue such as `token =`).

Defined results: null and empty texts have no spans; texts of any length are read whole; repeated rows give repeated
rows; other columns are not read; a null doc_id stays null.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import map_texts

KINDS = ("email", "ip", "card", "phone", "url", "account", "secret")
BASE = 4

# The grammar of the parts that the local parsers read from an anchor on.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[a-z]+://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?")
IDENT = re.compile(r"(?:\s?(?:number|no\.?|nr\.?|id))?\s{0,3}[:=#]?\s{0,3}([A-Z0-9](?:[ -]?[A-Z0-9]){7,33})(?![A-Za-z0-9])")
SECRET = re.compile(r"\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_=.-]{16,})")
SCHEMES = ("http://", "https://", "ftp://")
ACCOUNT_CUES = ("iban", "IBAN", "Iban", "account", "Account", "konto", "Konto", "cuenta", "Cuenta", "compte", "Compte")
SECRET_CUES = ("token", "api_key", "apikey", "secret", "password", "passwd")
# End of fixed values.


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for cues, what in (("@", "@"), ("+", "+"), ("0123456789", "0"), (SCHEMES, "url"), (ACCOUNT_CUES, "account"), (SECRET_CUES, "secret")):
        for c in cues:
            a.add_word(c, (what, len(c)))
    a.make_automaton()
    return a


_AUTOMATON: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end), in that order."""
    if not _AUTOMATON:
        _AUTOMATON.append(_automaton())
    found: list[tuple[int, int, int]] = []
    free = [0] * len(KINDS)  # where the next match of a kind may begin
    run = -1  # end of the digits that the last one belonged to
    for last, (what, size) in _AUTOMATON[0].iter(text):
        at = last - size + 1
        if what == "0":
            if at >= free[2]:
                if (m := CARD.match(text, at)) is not None:
                    free[2] = m.end()
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        found.append((at, 2, m.end()))
            if at > run:
                run = at
                while run + 1 < len(text) and "0" <= text[run + 1] <= "9":
                    run += 1
                if at >= free[1] and text[run + 1 : run + 2] == "." and (m := QUAD.match(text, at)):
                    free[1] = m.end()
                    if all(len(g.lstrip("0")) <= 3 and int(g) <= 255 for g in m.groups()):
                        found.append((at, 1, m.end()))
        elif what == "@":
            start = at
            while start > free[0] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                free[0] = m.end()
                found.append((start, 0, m.end()))
        elif what == "+":
            if at >= free[3] and (m := PHONE.match(text, at)):
                free[3] = m.end()
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    found.append((at, 3, m.end()))
        elif what == "url":
            if at >= free[4] and (m := URL.match(text, at)):
                end = at + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    free[4] = end
                    found.append((at, 4, end))
        elif what == "account":
            m = IDENT.match(text, last + 1)
            if m and m.start(1) >= free[5] and m.start(1) > last + 1 and sum(c.isdigit() for c in m[1]) >= 2:
                free[5] = m.end(1)
                found.append((m.start(1), 5, m.end(1)))
        elif (m := SECRET.match(text, last + 1)) and m.start(1) >= free[6]:
            free[6] = m.end(1)
            found.append((m.start(1), 6, m.end(1)))
    return sorted(found)


def listed(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans and the counts of the added kinds; no shuffle."""
    names = [f"n_{k}" for k in KINDS]

    def run(texts: list[str]) -> list[list]:
        rows = []
        for t in texts:
            found = spans(t)
            kinds = [k for _, k, _ in found]
            base = listed([s for s in found if s[1] < BASE]) if found else ""
            rows.append((*map(kinds.count, range(len(KINDS))), hashlib.sha256(base.encode()).hexdigest(), listed(found)))
        return list(zip(*rows))

    fields = ", ".join([*(f"{n} long" for n in names), "base_sha256 string", "spans string"])
    return map_texts(docs.select(F.col("doc_id").cast("long"), "text"), run, fields)
