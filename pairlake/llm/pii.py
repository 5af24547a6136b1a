"""Operator 10: personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits,
URL schemes and identifier cues.  Each anchor is handed to the local parser of
its kind, which expands it to its boundaries and validates it:

email    local part to the left of the at-sign, dotted domain to its right
ip       four dotted numbers from the first digit of a run, each at most 255
card     digits with single blanks or hyphens, 14 to 19 of them, Luhn checksum
phone    a plus sign, digits and separators, 10 to 15 digits
url      scheme, host and path (http, https, ftp)
account  the value after a cue and its separators (number, no, is, then signs
         of : = #), or a cloud access key.  Values have 6 characters, one of
         them a digit, or more, and no upper length:
         secrets (password, token, secret, api_key, ...) run to the closing
         quote on their line if they open with a quote, else to the next blank
         without closing punctuation;
         numbers (account, ssn, passport, ...) are letters, digits and joints
         (- _ / and . before a digit), then blank-separated groups of capitals
         and digits with a digit;
         an IBAN also stands in printed groups and without a separator, as
         long as its check digits hold (mod 97), and so does an SSN of nine
         digits without a separator;
         a bearer token stands behind blanks alone and has 16 characters or more;
         a private key runs from its BEGIN line to its END line.
         Cues and schemes count in any case, and inside a name where a capital
         follows a small letter (accessToken)

The first four kinds equal a leftmost non-overlapping scan per kind: a parser
starts at or after the end of its kind's previous match, and a match that fails
its validation is dropped and not tried again from within.

Defined results: spans are in code points, end exclusive, ordered by start and
then kind in the order above; a null text is empty and has none (and stays null
when redacted); spans of different kinds may overlap; other columns are passed
through, one named like an added column is replaced; an empty table gives an
empty table.  Every parser is linear in the text, so very long texts are taken
whole.
"""

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairlake.llm.text import Numbered, arrow_column

KINDS = ("email", "ip", "card", "phone", "url", "account")
SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_URL = re.compile(r"[a-z]+://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"']*)?", re.I)
_SEPARATORS = re.compile(r"[\"')\]]*[ \t]*(?:(?:(?:number|no\.?|is)(?![A-Za-z_])[ \t]*)+(?:[:=#]+>?[ \t]*)*"
                         r"|(?:[:=#]+>?[ \t]*)+|number|no\.?|is)", re.I)
_SECRET = re.compile(r"\S+")
_CLOSED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+{q}") for q in "\"'"}
_NUMBER = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]*(?:(?:[_/]|\.(?=[0-9]))[A-Za-z0-9-]+)*"
                     r"(?: (?=[A-Z0-9]*[0-9])[A-Z0-9]{2,}+(?![A-Za-z0-9]))*")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}", re.I | re.A)
_SSN = re.compile(r"[0-9]{3}([ -]?)[0-9]{2}\1[0-9]{4}(?![A-Za-z0-9])")
_BLANKS = re.compile(r"[ \t]*[\"']?")
_ACCESS_KEY = re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
SCHEMES = ("http://", "https://", "ftp://")
SECRETS = ("password", "passwd", "pwd", "token", "secret", "api_key", "apikey", "api-key")
CUES = (*SECRETS, "bearer", "account", "acct", "iban", "ssn", "passport")
LEAST = 6  # characters of an account value
LEAST_BEARER = 16  # of one that stands behind its cue without a separator
_KEY_BEGIN = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _anchors() -> ahocorasick.Automaton:
    """Over texts whose A-Z are in lower case."""
    found = ahocorasick.Automaton()
    found.add_word("@", ("email", 1))
    found.add_word("+", ("phone", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    for s in SCHEMES:
        found.add_word(s, ("url", len(s)))
    for c in CUES:
        found.add_word(c, ("cue", len(c)))
    found.add_word("akia", ("key", 4))
    found.add_word("-----begin ", ("pem", 11))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _iban_end(text: str, at: int) -> int:
    """End of the longest IBAN at ``at`` that ends where a group ends; 0 if none."""
    m = _IBAN.match(text, at)
    end = m.end() if m else 0
    while end > at:
        code = text[at:end].replace(" ", "").replace("-", "").upper()
        if len(code) < 15:
            break
        if not text[end:end + 1].isalnum() and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return end
        end -= 1
        while text[end - 1] in " -":
            end -= 1
    return 0


def _secret_end(text: str, first: int, last: int) -> int:
    """End of the run of non-blanks without the punctuation that closes it; a
    bracket that the run itself opens belongs to it."""
    run = text[first:last]
    foreign = {c: run.count(c) - run.count(o) for o, c in ("()", "[]", "{}", "<>")}
    while last > first and (text[last - 1] in ".,;:\"'`" or foreign.get(text[last - 1], 0) > 0):
        last -= 1
        if text[last] in foreign:
            foreign[text[last]] -= 1
    return last


class _Values:
    """The values after the cues of one text.  What a search without a result
    has read is not read again, so all searches together are linear."""

    def __init__(self, text: str):
        self.text = text
        self.open = {"\"": -1, "'": -1}  # no such quote closes on this line before here
        self.plain = {_SECRET: -1, _NUMBER: -1}  # the run up to here has no digit

    def _fit(self, first: int, last: int) -> tuple[int, int] | None:
        return (first, last) if last - first >= LEAST and _DIGITS.search(self.text, first, last) else None

    def _quoted(self, at: int) -> tuple[int, int] | None:
        quote = self.text[at - 1]
        if quote not in self.open or at < self.open[quote]:
            return None
        m = _CLOSED[quote].match(self.text, at)
        if m:
            return at, m.end() - 1
        end = self.text.find("\n", at)
        self.open[quote] = len(self.text) if end < 0 else end
        return None

    def _run(self, pattern: re.Pattern, at: int) -> tuple[int, int] | None:
        m = pattern.match(self.text, at) if at >= self.plain[pattern] else None
        if m and not _DIGITS.search(self.text, at, m.end()):
            self.plain[pattern] = m.end()
            return None
        return m and self._fit(at, _secret_end(self.text, at, m.end()) if pattern is _SECRET else m.end())

    def after(self, cue: str, at: int) -> tuple[int, int] | None:
        """(start, end) of the value of a cue that ends at ``at``."""
        m = _SEPARATORS.match(self.text, at)
        first = _BLANKS.match(self.text, m.end() if m else at).end()
        if cue == "iban" and (first > at) and (end := _iban_end(self.text, first)):
            return first, end
        if cue == "bearer":
            span = self._run(_SECRET, first) if first > at else None
            return span if span and span[1] - span[0] >= LEAST_BEARER else None
        if not m:
            m = _SSN.match(self.text, first) if cue == "ssn" and first > at else None
            return m and m.span()
        if cue not in SECRETS:
            return self._run(_NUMBER, first)
        closed = self._quoted(first)
        return (closed and self._fit(*closed)) or self._run(_SECRET, first)


class Finder:
    """``finder(text)`` -> spans (kind, start, end); built once per task."""

    def __init__(self):
        self._scan = _anchors().iter

    def __call__(self, text: str | None) -> list[tuple[str, int, int]]:
        if not text:
            return []
        out = []
        email_at = ip_at = card_at = phone_at = url_at = account_at = 0  # where each kind may start next
        values, keys_end = _Values(text), True
        for last, (kind, width) in self._scan(text.lower() if text.isascii() else text.translate(_LOWER)):
            at = last - width + 1
            if kind == "digit":
                if at >= card_at:
                    m = _CARD.match(text, at)
                    card_at = m.end() if m else at + 1
                    if m:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 14 <= len(digits) <= 19 and luhn(digits):
                            out.append(("card", at, m.end()))
                if at >= ip_at:
                    m = _IP.match(text, at)
                    ip_at = m.end() if m else _DIGITS.match(text, at).end()
                    if m and all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups())):
                        out.append(("ip", at, m.end()))
            elif kind == "email":
                start = at
                while start > email_at and text[start - 1] in _LOCAL:
                    start -= 1
                m = _DOMAIN.match(text, at + 1) if start < at else None
                if m:
                    out.append(("email", start, m.end()))
                    email_at = m.end()
            elif kind == "phone":
                if at >= phone_at and (m := _PHONE.match(text, at)):
                    phone_at = m.end()
                    if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                        out.append(("phone", at, m.end()))
            elif kind == "url":
                if at >= url_at and (m := _URL.match(text, at)):
                    end = len(m[0].rstrip(".,;:!?)")) + at
                    out.append(("url", at, end))
                    url_at = m.end()
            elif kind == "pem":
                if at >= account_at and keys_end and (m := _KEY_BEGIN.match(text, at)):
                    m = _KEY_END.search(text, m.end())
                    keys_end = m is not None  # none ends from here on
                    if m:
                        out.append(("account", at, m.end()))
                        account_at = m.end()
            elif at >= account_at and (not (at and text[at - 1].isalnum()) or text[at - 1].islower() and text[at].isupper()):
                if kind == "cue":
                    span = values.after(text[at:last + 1].lower(), last + 1)
                else:
                    span = (m := _ACCESS_KEY.match(text, at)) and m.span()
                if span:
                    out.append(("account", *span))
                    account_at = span[1]
        out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        return out


def find(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Append ``out``: array of (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def kernel():
        finder = Finder()
        names = ("kind", "start", "end")
        return lambda texts: pa.array([[dict(zip(names, s, strict=True)) for s in finder(t)]
                                       for t in texts.to_pylist()], type=kind)

    rows = Numbered(df)
    return rows.named(rows.df.withColumn("spans", arrow_column(kernel, SPANS)(F.col(rows(text)))), **{out: "spans"})


def redact_text(text: str, spans) -> str:
    """The text with every span as ``[KIND]``; overlapping spans become one,
    named after the first."""
    out, end = [], 0
    for kind, first, last in spans:
        if first >= end:
            out += [text[end:first], f"[{kind.upper()}]"]
        end = max(end, last)
    return "".join([*out, text[end:]])


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with every span of ``text`` replaced by its kind in brackets."""
    def kernel():
        finder = Finder()

        def one(t):
            spans = finder(t)
            return redact_text(t, spans) if spans else t
        return lambda texts: pa.array(map(one, texts.to_pylist()), type=pa.string())

    rows = Numbered(df)
    return rows.named(rows.df.withColumn(rows(text), arrow_column(kernel, "string")(F.col(rows(text)))))
