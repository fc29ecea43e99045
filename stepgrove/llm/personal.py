"""Personal data by patterns that propose spans, checks that confirm them and nearby words that adjust their score.

Base kinds are kept whenever their own check holds: email addresses, IP addresses with parts up to 255, card numbers of
16 to 19 digits by Luhn's checksum, international phone numbers of 8 to 15 digits. The method adds kinds that need more
evidence: bank accounts by the mod-97 checksum and the length of their country, short card numbers by Luhn's checksum,
social security numbers by their ranges, phone numbers without a country code. Each starts from the score that its check
earns; words of its theme close by raise it, words of another theme lower it, and spans of LEAST or more are kept.

Every pattern is written so that a text is read once whatever it holds: a match may only start where a run starts.
"""

import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import functions as F

from .catalog import query, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_short", "ssn", "phone_local")
KINDS = BASE + ADDED
#: The least score of an added span, what a word nearby adds or takes, and how near it is, in code points.
LEAST = 0.5
RAISE, LOWER = 0.35, 0.35
NEAR = 48

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9A-Za-z-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9A-Za-z+.()-])(?:\([0-9]{2,5}\) ?|0[0-9]{1,4}[ /.-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z-])")

# Lengths of bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Words of a kind's theme in English, German, French and Spanish, and words that speak against a number.
_THEMES = {
    "iban": "iban bic swift bank account konto bankverbindung compte virement cuenta banco transfer",
    "card_short": "card credit visa mastercard amex express kreditkarte karte carte tarjeta crédito crédit payment",
    "ssn": "ssn social security sozialversicherung tin taxpayer",
    "phone_local": "phone tel telephone telefon téléphone teléfono telefono mobile mobil cell call fax handy whatsapp portable móvil anrufen appeler llamar",
}
_AGAINST = "isbn issn order version serial sku part ticket invoice article page pages doi rfc bestellung artikel seite commande pedido página"
_START = {"iban": 0.9, "card_short": 0.3, "ssn": 0.3, "phone_local": 0.25}
_CONTEXT = {k: re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, v.split()))})(?![^\W\d_])", re.I) for k, v in _THEMES.items()}
_OTHER = re.compile(rf"(?<![^\W\d_])(?:{'|'.join(map(re.escape, _AGAINST.split()))})(?![^\W\d_])", re.I)


def luhn(digits):
    """If a text of digits has Luhn's checksum."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9)
    return total % 10 == 0


def mod97(account):
    """If an account number without blanks has remainder 1 (its first four characters moved to the end)."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text):
    """(start, end) of the addresses, leftmost first: only the run before an @ can start one."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        last = domain.end() if domain else at + 1
        if domain:
            found.append((start, last))
        at = text.find("@", last)
    return found


def addresses(text):
    """(start, end) of the IP addresses."""
    small = lambda part: len(part := part.lstrip("0")) < 4 and int(part or 0) < 256
    return [m.span() for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]


def _digits(text):
    return "".join(c for c in text if "0" <= c <= "9")


def _iban(text):
    """Accounts: the candidate is cut to the length of its country, wherever its groups end."""
    m = _IBAN.search(text)
    while m:
        length, end = IBAN_LENGTHS.get(m[0][:2], 0), m.start()
        left = length
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        sound = length and not left and not text[end : end + 1].isalnum() and mod97(text[m.start() : end].replace(" ", ""))
        if sound:
            yield m.start(), end
        m = _IBAN.search(text, end if sound else m.start() + 1)


def _numbers(text):
    """Runs of digits with single blanks or hyphens: (start, end, digits)."""
    return [(*m.span(), _digits(m[0])) for m in _CARD.finditer(text)]


def _ssn(text):
    for m in _SSN.finditer(text):
        if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            yield m.span()


def score(kind, text, start, end):
    """The score of an added span from its kind and the words near it."""
    near = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    value = _START[kind]
    value += RAISE * any(map(_CONTEXT[kind].search, near))
    value -= LOWER * any(map(_OTHER.search, near))
    return round(min(1.0, max(0.0, value)), 2)


def spans(text):
    """(kind, start, end, score) of all personal data in a text, by kind in the order of KINDS, then by start."""
    found = [("email", *s, 1.0) for s in (emails(text) if "@" in text else [])]
    found += [("ip", *s, 1.0) for s in addresses(text)]
    numbers = _numbers(text)
    found += [("card", a, b, 1.0) for a, b, d in numbers if 16 <= len(d) <= 19 and luhn(d)]
    if "+" in text:
        found += [("phone", *m.span(), 1.0) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    taken = sorted((a, b) for _, a, b, _ in found)
    starts, ends = [a for a, _ in taken], sorted(b for _, b in taken)

    def free(start, end):
        return bisect_left(starts, end) == bisect_right(ends, start)

    if not numbers:  # every added kind holds two digits in a row
        return found
    more = [("iban", *s) for s in _iban(text)]
    accounts = [(a, b) for _, a, b in more]
    more += [("card_short", a, b) for a, b, d in numbers if 13 <= len(d) <= 15 and luhn(d) and free(a, b)]
    more += [("ssn", *s) for s in _ssn(text) if free(*s)]
    more += [("phone_local", *m.span()) for m in _LOCAL_PHONE.finditer(text) if 7 <= len(_digits(m[0])) <= 12 and free(*m.span())]
    for kind, a, b in more:
        if kind == "iban" or not any(x < b and a < y for x, y in accounts):
            s = score(kind, text, a, b)
            if s >= LEAST:
                found.append((kind, a, b, s))
    return found


def find(docs, id="doc_id", text="text"):
    """One row per row of ``docs``: id, text and spans, an array of (kind, start, end, score).

    Positions count code points, ends are exclusive; spans are ordered by kind as in KINDS, then by start, and spans of
    different kinds may overlap only where one is of a base kind or an account. Null texts are empty and have no
    span (text stays null); bytes that aren't UTF-8 count as replacement characters. Rows that repeat have a row each, an empty table gives
    an empty table, and other columns play no part. Whole texts are read in time linear in their length; no shuffle.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = ["kind", "start", "end", "score"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [[dict(zip(names, s)) for s in spans((data or b"").decode("utf-8", "replace"))] for data in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], names=["id", "text", "spans"])

    plain = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("text"))
    out = plain.mapInArrow(run, "id bigint, text binary, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return out.select(F.col("id").alias(id), F.col("text").cast("string").alias(text), "spans")


def mask(found, id="doc_id", text="text"):
    """The rows of ``find`` with every span replaced by its kind, as ``<EMAIL>``; of spans that overlap the widest first one counts."""
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def add(state, s):
        keep = F.struct(
            F.concat(state["out"], F.substring(F.col(text), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"),
            (-s["back"]).alias("at"),
        )
        return F.when(s["start"] >= state["at"], keep).otherwise(state)

    end = lambda state: F.concat(state["out"], F.substring(F.col(text), (state["at"] + 1).cast("int"), F.length(F.col(text))))
    return found.select(id, F.aggregate(ordered, zero, add, end).alias(text))


def listed(found):
    """``kind:start:end`` of an array of spans, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op13_personal_data")
def op13_personal_data(spark, folder):
    found = find(table(spark, folder, "documents")).drop("text")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    kind = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kind) - F.size(F.array_remove(kind, k))).cast("bigint").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
