"""Personal data replaced by keyed, type-consistent surrogates.

Patterns find e-mail addresses, phone and card numbers, IP addresses, social-security numbers, bank accounts, keys and passwords, dates after a word for birth, streets with a
house number, and names after a form of address, with initials and particles. An entity's canonical form (case, separators and country prefix set aside) and the secret key
decide its surrogate, so every mention of an entity gets the same one, in the mention's own format: letters stay letters of
their script and case, digits stay digits, check digits stay valid (numbers without a valid one are no cards and no bank accounts), names keep the gender of their form of address.
A name, password or key that a document has shown to be one is replaced wherever the document repeats it, with or without a form of address, as written, capitalised or in capitals; a name in small
letters may be a word ("may") and stays, and so does a month's name in a date ("in May"). The parts of a hyphenated name are entities of their own, so each is known wherever it recurs. A given name has one gender in a document.
All distinct entities of the corpus are then checked: where two of a kind would get one surrogate, or a surrogate is another
entity's original, the later ones draw again with the next attempt number, until none are left. After OWN_LENGTH attempts each
further one draws from more values (names get another syllable, secrets, keys, mailboxes and short phone numbers another
digit, private addresses a wider network), so that this ends whatever the number of entities. Masks such as ******** and
keys without letters or digits aren't entities.

Defined results: a null text stays null, a text without entities stays as it is; whole texts are read; repeated rows get
equal results; an empty table gives an empty result; other columns pass through, except those named entities or n_entities, which are replaced.
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import random
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, unused
from .hashing import slices

#: Entities that had to draw again are broadcast up to this number; beyond it they are joined by text hash.
BROADCAST_ENTITIES = 100_000
#: Attempts at an entity's own length; the later ones are longer by one unit each.
OWN_LENGTH = 3
#: What secrets without letters and digits are drawn from.
SYMBOLS = "!#$%&*+-./:<=>?@^_|~"

# Forms of address with the gender they state, and name endings by gender and script.
FORMS = {
    "Mr": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Господин": "m", "Κύριος": "m",
    "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f", "Sra": "f", "Señorita": "f", "Госпожа": "f", "Κυρία": "f",
    "Dr": "n", "Prof": "n", "Professor": "n",
}
SYLLABLES = {
    "latin": ("ba", "be", "da", "do", "fe", "ga", "ka", "la", "le", "lo", "ma", "me", "mi", "na", "ne", "no", "ra", "re", "ri", "ro", "sa", "se", "ta", "te", "to", "va", "ve", "vi"),
    "cyrillic": ("ба", "бо", "ва", "ве", "да", "до", "ка", "ко", "ла", "ле", "ма", "ме", "на", "но", "ра", "ре", "са", "се", "та", "то"),
    "greek": ("βα", "γα", "δα", "δο", "κα", "κο", "λα", "λε", "μα", "με", "να", "νο", "ρα", "ρο", "σα", "σε", "τα", "το"),
}
ENDINGS = {
    "latin": {"m": ("rd", "n", "s"), "f": ("ra", "na", "lia"), "n": ("n", "l", "r")},
    "cyrillic": {"m": ("н", "р", "в"), "f": ("ина", "ра", "ва"), "n": ("н", "р", "л")},
    "greek": {"m": ("ρος", "νης", "λος"), "f": ("ρα", "νη", "λα"), "n": ("ς", "ν", "ρ")},
}
# A capital, a name with its apostrophes and hyphens (a genitive's s is no part of it), and what may come before one: initials and particles.
_CAPITAL = r"[^\W\d_a-zß-öø-ÿа-яά-ώ]"
_NAME = rf"{_CAPITAL}(?:[^\W\d_]+|(?=['’][^\W\d_]{{2}}))(?:['’][^\W\d_]{{2,}}|-{_CAPITAL}[^\W\d_]+)*"
_LEAD = rf"(?:{_CAPITAL}\. ?){{0,3}}(?:(?:von|van|vom|zu|de|del|der|den|di|da|du|la|le) ){{0,2}}"
_MONTHS = frozenset("january february march april may june july august september october november december".split())
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "secret": r"(?i:(?:\b|_)(?:password|passwd|pwd|passphrase|token|secret|api[_\-]?key|access[_\-]?key)\b[\"']?[ \t]{0,3}[=:][ \t]{0,3}[\"']?)(?P<value>[^\s\"',;]{6,})",
    "key": r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_\-]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{30,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ipv6": r"(?<![\w:.])(?=(?:[0-9A-Fa-f]{0,4}:){2})[0-9A-Fa-f:]{6,39}(?![\w:])",
    "birth": r"(?i:\b(?:born(?: on)?|date of birth|birth ?date|dob|geboren(?: am)?|geb\.(?: am)?|geburtsdatum|née? le|nacid[oa] el|fecha de nacimiento)[ \t]{0,2}:?[ \t]{0,3})(?P<day>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./\-][0-9]{1,2}[./\-][0-9]{4})(?!\w)",
    "address": rf"(?<!\w)(?:[0-9]{{1,5}}[a-z]? (?:{_CAPITAL}[^\W\d_]+ ){{1,3}}(?:Street|Road|Avenue|Lane|Drive|Boulevard|Square)|{_CAPITAL}[^\W\d_]*(?:straße|strasse|weg|platz|allee|gasse) [0-9]{{1,4}}[a-z]?)(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])",
    "card": r"(?<![\w.+\-])[3-6][0-9]{3}[ \-]?[0-9]{4}[ \-]?[0-9]{4}[ \-]?[0-9]{1,4}(?:[ \-]?[0-9]{1,3})?(?![\w\-]|\.[0-9])",
    "ssn": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "phone": r"(?<![\w.])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-][0-9]{2,5}){1,4}|\+[0-9]{8,14}|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}|(?<!\-)0[1-9][0-9]{1,3}[ /\-][0-9]{3,8}(?:[ \-][0-9]{3,5})?)(?![\w\-])",
    "name": rf"\b(?P<form>{'|'.join(sorted({*FORMS, *map(str.upper, FORMS)}, key=lambda x: (-len(x), x)))})\.? (?P<who>{_LEAD}{_NAME}(?: {_LEAD}{_NAME})?)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_KEY_HEAD = re.compile(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ")
_HINT = re.compile(r"[0-9@=:]|\b(?:" + "|".join((*FORMS, *map(str.upper, FORMS))) + r")\b")
_PART = re.compile(r"[^ \-]+")
_DATED = re.compile(r"(?i:\b(?:in|of|by|on|since|until|till|during|early|mid|late|next|last|this|from|to|[0-9]{1,2}(?:st|nd|rd|th)?)[ \-]$)")
_HOUSE = re.compile(r"(?P<no>[0-9]+)(?P<letter>[a-z]?) (?P<street>.+?)(?P<kind> \w+)|(?P<street2>.+?)(?P<kind2>straße|strasse|weg|platz|allee|gasse) (?P<no2>[0-9]+)(?P<letter2>[a-z]?)")


def _script(word: str) -> str:
    return "cyrillic" if re.search("[Ѐ-ӿ]", word) else "greek" if re.search("[Ͱ-Ͽ]", word) else "latin"


def entities(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(kind, canonical form, start, end) of each mention in a text, in order."""
    if not _HINT.search(text):
        return
    base = 0
    for line in text.split("\n"):  # no pattern crosses a line
        if _HINT.search(line):
            yield from ((k, f, base + i, base + j) for k, f, i, j in _line_entities(line))
        base += len(line) + 1


def mentions(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, canonical form, start, end) of each mention in a text, in order: entities, and names, passwords and keys found as such that recur elsewhere."""
    found = list(entities(text))
    gender = {f: k for k, f, _, _ in reversed(found) if k in ("given_m", "given_f")}
    found = [(gender.get(f, k) if k == "given_n" else k, f, i, j) for k, f, i, j in found]
    known = {}
    for k, f, i, j in reversed(found):
        if k in ("secret", "key"):
            known[text[i:j]] = (k, f)
        elif k == "surname" or k.startswith("given_"):
            known.update({x: (k, f) for word in (text[i:j], text[i:j].replace("’", "'"), text[i:j].replace("'", "’")) for x in (word, word.upper(), _capitals(word))})
    if known:
        taken, out = iter(found), []
        span = next(taken, None)
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(known, key=lambda x: (-len(x), x))) + r")(?!\w)", text):
            while span and span[3] <= m.start():
                span = next(taken, None)
            if m[0].casefold() in _MONTHS and (_DATED.search(text, max(0, m.start() - 12), m.start()) or re.match(r" [0-9]{1,4}\b", text[m.end() : m.end() + 6])):
                continue
            if not span or m.end() <= span[2]:
                out.append((*known[m[0]], *m.span()))
        found = sorted(found + out, key=lambda x: x[2])
    return found


def _capitals(word: str) -> str:
    """A name with a capital at its start and after an apostrophe."""
    return re.sub(r"[^'’]+", lambda m: m[0].capitalize(), word)


def _line_entities(text: str) -> Iterator[tuple[str, str, int, int]]:
    pos = 0
    while m := _ANY.search(text, pos):
        pos = m.end()
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m[k] is not None)
        start, end = m.span(kind)
        if kind == "secret":
            start, end = m.span("value")
            if not _masked(m["value"]):
                yield kind, text[start:end], start, end
        elif kind == "key":
            if _variable(_KEY_HEAD.sub("", m[kind], count=1)):
                yield kind, m[kind], start, end
        elif kind == "name":
            gender, last = FORMS[m["form"] if m["form"] in FORMS else m["form"].capitalize()], m["who"].rfind(" ")
            for part in _PART.finditer(m["who"]):
                word, at = part[0], m.start("who") + part.start()
                if word[0].islower() or word.endswith("."):
                    continue  # particles and initials stay
                lead = re.match(r"(?:[^\W\d_]\.)+", word)
                word, at = (word[lead.end() :], at + lead.end()) if lead else (word, at)
                # the last word is the surname, which both genders share
                yield "surname" if part.start() > last else f"given_{gender}", f"{_script(word)}:{word.casefold().replace('’', chr(39))}", at, at + len(word)
        elif kind == "birth":
            start, end = m.span("day")
            a, b, c = re.split(r"\D", m["day"])
            yield kind, f"{a}-{b}-{c}" if len(a) == 4 else f"{c}-{b:0>2}-{a:0>2}", start, end
        elif kind == "address":
            yield kind, m[kind].lower(), start, end
        elif kind == "ipv6":
            form = _ipv6(m[kind])
            if form:
                yield kind, form, start, end
            else:
                pos = start + 1  # another entity may begin within
        elif kind == "card":
            number = next((x for x in (m[kind], m[kind].rpartition(" ")[0]) if _is_card(x)), None)  # a number beside the card may have been taken as its end
            if number:
                pos = start + len(number)
                yield kind, re.sub(r"\D", "", number), start, pos
            else:
                pos = start + 4  # a card or another entity may begin within
        elif kind in ("phone", "ssn"):
            digits = re.sub(r"\D", "", m[kind])
            if kind == "phone" and m[kind][0] == "0" and not 9 <= len(digits) <= 12:
                continue
            if kind == "phone" and len(digits) == 11 and digits[0] == "1":
                digits = digits[1:]
            yield kind, digits, start, end
        elif kind == "iban":
            bare = m[kind].replace(" ", "")
            if int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                yield kind, bare, start, end
        else:
            yield kind, m[kind].lower() if kind == "email" else m[kind], start, end


def _ipv6(text: str) -> str | None:
    """An address of three groups or more in its short form."""
    try:
        return ipaddress.IPv6Address(text).compressed if len([x for x in text.split(":") if x]) > 2 else None
    except ValueError:
        return None


def _luhn(digits: str) -> int:
    """The check digit that follows digits."""
    twice = [int(c) * (2 - i % 2) for i, c in enumerate(reversed(digits))]
    return -sum(x - 9 if x > 9 else x for x in twice) % 10


def _is_card(number: str) -> bool:
    digits = re.sub(r"\D", "", number)
    return len(digits) >= 13 and _luhn(digits[:-1]) == int(digits[-1])


def _variable(form: str) -> bool:
    """Whether a form has letters or digits."""
    return any(c.isalpha() or c.isdigit() for c in form)


def _masked(value: str) -> bool:
    """Whether a value is one symbol repeated, with brackets or a stop at its ends."""
    return not _variable(value) and len(set(value.strip("()[]{}<>.:!?`|") or value)) == 1


@functools.lru_cache(1024)
def _uncased(block: int) -> str:
    """Letters without case among 128 code points."""
    return "".join(c for c in map(chr, range(block * 128, block * 128 + 128)) if c.isalpha() and not c.islower() and not c.isupper())


def _like(form: str, rng: random.Random) -> str:
    """Random characters of the same classes, of the same script where it has no case; all-hexadecimal forms stay so."""
    lower = "abcdef" if re.fullmatch(r"[0-9a-f]+", form) else "abcdefghijklmnopqrstuvwxyz"
    upper = "ABCDEF" if re.fullmatch(r"[0-9A-F]+", form) else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return "".join(rng.choice("0123456789") if c.isdigit() else rng.choice(lower) if c.islower() else rng.choice(upper) if c.isupper() else rng.choice(_uncased(ord(c) // 128)) if c.isalpha() else c
                   for c in form)


def surrogate(kind: str, form: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the entity's replacement."""
    rng = random.Random(hashlib.blake2b(f"{kind}\0{form}\0{attempt}".encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest())
    longer = max(0, attempt - OWN_LENGTH + 1)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        local, _, domain = form.rpartition("@")
        own = random.Random(hashlib.blake2b(b"domain\0" + domain.encode(), key=key, digest_size=16).digest())  # one domain, one surrogate
        top = domain.rpartition(".")[2]
        return f"{_like(local, rng)}{digits(longer)}@{''.join(own.choice('bcdfghklmnprstvz') for _ in range(7))}.example.{top if top in ('com', 'org', 'net') else 'com'}"
    if kind == "secret":
        return _like(form, rng) + digits(longer) if _variable(form) else "".join(rng.choice(SYMBOLS) for _ in range(len(form) + longer))
    if kind == "key":
        head = _KEY_HEAD.match(form)[0]
        return head + _like(form[len(head):], rng) + digits(longer)
    if kind == "ip":
        old = ipaddress.ip_address(form) if not re.search(r"\b0[0-9]", form) else None
        keep = next((n for net, n in (("10.0.0.0/8", 1), ("192.168.0.0/16", 2), ("172.16.0.0/12", 2), ("127.0.0.0/8", 1)) if old and old in ipaddress.ip_network(net)), 0)
        if keep and longer:  # a private network can be full: 10.0.0.0/8 first, any network then
            form, keep = "10", int(longer <= OWN_LENGTH)
        parts = form.split(".")[:keep] + [str(rng.randrange(1, 255)) for _ in range(4 - keep)]
        if not keep:
            parts[0] = str(rng.choice([x for x in range(11, 224) if x not in (127, 172, 192, 198, 203, 169, 100)]))
        return ".".join(parts)
    if kind == "ipv6":
        return ipaddress.IPv6Address((0x20010DB8 << 96) | rng.getrandbits(96)).compressed
    if kind == "birth":  # day and month from 1 to 12, so that it is a date in either order
        return f"{rng.randrange(1000, 10 ** (3 + longer)) if longer > 1 else rng.randrange(1930, 2010)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 13):02d}"
    if kind == "address":
        m = _HOUSE.fullmatch(form)
        no = m["no"] or m["no2"]
        number = f"{rng.randrange(10 ** (len(no) - 1), 10 ** len(no))}{m['letter'] or m['letter2'] or ''}"
        street = "".join(rng.choice(SYLLABLES["latin"]) for _ in range(3 + longer)) + rng.choice(ENDINGS["latin"]["n"])
        return f"{number} {street}{m['kind']}" if m["no"] else f"{street}{m['kind2']} {number}"
    if kind == "card":
        body = form[0] + "".join(rng.choice("0123456789") for _ in form[1:-1])
        return body + str(_luhn(body))
    if kind == "iban":
        body = _like(form[4:], rng)
        check = 98 - int("".join(str(int(c, 36)) for c in body + form[:2] + "00")) % 97
        return f"{form[:2]}{check:02d}{body}"
    if kind == "phone":
        keep = max(int(form[0] == "0"), len(form) - 10)  # a country prefix stays, and so does a leading 0
        return form[:keep] + "".join(rng.choice("23456789" if i in (0, 3) else "0123456789") for i in range(len(form) - keep)) + digits(longer if len(form) < 10 else 0)
    if kind == "ssn":
        return f"{rng.randrange(10) if longer else 9}{rng.randrange(100):02d}{rng.randrange(1, 100):02d}{rng.randrange(1, 10000):04d}"
    script = form.partition(":")[0]
    ending = rng.choice(ENDINGS[script][kind[-1] if kind.startswith("given_") else "n"])
    return f"{script}:{''.join(rng.choice(SYLLABLES[script]) for _ in range(3 + longer))}{ending}"


def in_format(kind: str, mention: str, new: str) -> str:
    """The canonical replacement in the mention's own format."""
    if kind in ("phone", "card", "ssn", "iban"):
        slots = [i for i, c in enumerate(mention) if c.isalnum()]
        out = list(mention)
        own, more = new[:len(slots)], new[len(slots):]
        for i, c in zip(slots[len(slots) - len(own):], own):
            out[i] = c
        return "".join(out) + more
    if kind == "email":
        return new.upper() if mention.isupper() else new.capitalize() if mention[:1].isupper() else new
    if kind == "surname" or kind.startswith("given_"):
        head = re.match(r"\w{1,2}['’](?=\w)", mention)  # O' and D' stay
        word = new.partition(":")[2]
        return (head[0] if head else "") + (word.upper() if mention.isupper() and len(mention) > 1 else word.capitalize())
    if kind == "ipv6":
        return new.upper() if mention.upper() == mention and mention.lower() != mention else new
    if kind == "birth":
        fields = new.split("-")
        order = iter(fields if re.match("[0-9]{4}", mention) else fields[::-1])
        return re.sub("[0-9]+", lambda _: next(order), mention)
    if kind == "address":
        return " ".join(w.capitalize() for w in new.split(" "))
    return new


def redrawn(found: DataFrame, key: bytes) -> DataFrame:
    """kind, form, attempt of the entities whose first surrogates collide, from the distinct entities (kind, form) of the corpus."""
    def drawn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.assign(new=[surrogate(k, f, key, a) for k, f, a in zip(part["kind"], part["form"], part["attempt"])])

    now = stored(found.withColumn("attempt", F.lit(0)).mapInPandas(drawn, "kind string, form string, attempt int, new string"))
    originals = found.select("kind", F.col("form").alias("new"), F.lit(True).alias("real"))
    while True:
        order = Window.partitionBy("kind", "new").orderBy("attempt", "form")
        shared = now.groupBy("kind", "new").count().where("count > 1").select("kind", "new")
        twice = now.join(shared, ["kind", "new"], "left_semi").withColumn("place", F.row_number().over(order)).where("place > 1").drop("place")
        taken = now.join(originals, ["kind", "new"], "left_semi")
        losers = stored(twice.unionByName(taken).select("kind", "form", (F.col("attempt") + 1).alias("attempt")).distinct())
        if not losers.head(1):
            return now.where("attempt > 0").select("kind", "form", "attempt")
        again = losers.mapInPandas(drawn, "kind string, form string, attempt int, new string")
        now = stored(now.join(losers.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(again))


def replaced(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    if not text:
        return text, []
    out, spans, at = [], [], 0
    for kind, form, start, end in mentions(text):
        new = in_format(kind, text[start:end], surrogate(kind, form, key, attempts.get((kind, form), 0)))
        out += [text[at:start], new]
        spans.append({"kind": kind, "start": start, "end": end, "surrogate": new})
        at = end
    return "".join([*out, text[at:]]), spans


def surrogate_pii(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with personal data in text_col replaced; entities lists kind, start and end (in the old text) and surrogate; n_entities counts them."""
    secret = hashlib.sha256(key.encode()).digest()
    names = [c for c in docs.columns if c not in ("entities", "n_entities")]
    docs = docs.select(names)
    own_sha, own_again = unused(docs, "sha"), unused(docs, "again")
    texts = docs.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    sha = F.sha2(F.col(text_col), 256)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(s, k, f) for s, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))) for k, f, _, _ in mentions(text)})
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["sha", "kind", "form"])

    listed_all = stored(texts.select(F.sha2("text", 256).alias("sha"), "text").mapInArrow(listed, "sha string, kind string, form string"))
    again = stored(redrawn(stored(listed_all.select("kind", "form").distinct()), secret))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in names]
                          + [T.StructField("entities", T.ArrayType(T.StructType.fromDDL("kind string, start int, end int, surrogate string"))), T.StructField("n_entities", T.LongType())])
    n = again.count()
    held = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["form"]): r["attempt"] for r in again.toLocalIterator()} if n <= BROADCAST_ENTITIES else {})
    if n > BROADCAST_ENTITIES:
        own = listed_all.join(again, ["kind", "form"]).groupBy("sha").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias(own_again))  # those of one text
        docs = docs.withColumn(own_sha, sha).join(own.withColumnRenamed("sha", own_sha), own_sha, "left").drop(own_sha)

    at = {c: i for i, c in enumerate(docs.columns)}
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i, j in slices(whole.column(at[text_col])):
                batch = whole.slice(i, j - i)
                texts = batch.column(at[text_col]).to_pylist()
                own = [{(x["kind"], x["form"]): x["attempt"] for x in a or ()} for a in batch.column(at[own_again]).to_pylist()] if own_again in at else [held.value] * len(texts)
                done = [replaced(text, secret, a) for text, a in zip(texts, own)]
                columns = [pa.array([x[0] for x in done], batch.column(at[c]).type) if c == text_col else batch.column(at[c]) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([x[1] for x in done], spans), pa.array([len(x[1]) for x in done], pa.int64())], [*names, "entities", "n_entities"])

    return docs.mapInArrow(rewritten, schema)
