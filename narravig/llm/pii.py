"""Personal information in free text: where it is, and the text with placeholders in its place.

E-mail and street addresses, labelled identity numbers and phone numbers are found by their forms; names by what stands
around them (titles, roles, labels, verbs of telling, contact details behind a comma) and by their own shape. What an
earlier kind covers a later one may not: an e-mail address's local part is no name. Redaction writes ``[KIND value]``.
Numbers are checked (ranges, check digits); numbers and dates are replaced by a keyed Feistel permutation within their
format: same digits' count and separators, the same checks passed, days of the calendar. So equal values stay equal
across documents and formats, and the key gives them back; names and addresses get a keyed tag of 80 bits instead.

Defined results: null and blank texts give no mention and come out as they are; a text of any length is read whole;
repeated rows are reported once; offsets are code points; a date that isn't in the calendar gets a tag; without a secret
there are no pseudonyms but an error; extra columns are not looked at.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravig.functions.arrowmap import flat_map

KINDS = ("EMAIL", "ADDRESS", "ID", "PHONE", "NAME")

EMAIL = re.compile(
    r"(?<![\w.+-])[\w.+-]*\w\s?(?:@|\(at\)|\[at\]| \(at\) | \[at\] )\s?\w[\w-]*(?:\.[\w-]+)*\.[A-Za-z]{2,}\b"
    r"|(?<![\w.+-])[\w.+-]*\w (?:\(at\)|\[at\]|at) (?:[\w-]+ (?:\(dot\)|\[dot\]|dot) )+[A-Za-z]{2,}\b",
    re.IGNORECASE,
)

UP = r"[^\W\d_a-zß-öø-ÿ]"
STREET = (
    r"(?:Streets?|St|Avenue|Ave|Roads?|Rd|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Terrace|Ter|Crescent|Cres|Row|Place|Pl|Square|Sq|"
    r"Close|Alley|Parkway|Pkwy|Circle|Cir|Highway|Hwy|Walk|Gardens|Hill|Mews|Grove|Quay)"
)
#: Forms of street addresses, each with the bit of the words that a text must hold; 0: none, the form begins with digits.
SPANISH, BOX, DOT, LABEL, CUE, AT = 1, 2, 4, 8, 16, 32
GERMAN = re.compile(r"(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm)\s+\d")
ADDRESSES = tuple(
    (bit, re.compile(form))
    for bit, form in (
        # house number, name of up to four capitalised words, kind of street
        (
            0,
            rf"(?<![\w.,/:-])\d{{1,5}}[A-Z]?\s+(?:[NSEW]\.\s+)?(?:(?:St|Mt|Ft)\.\s+)?(?:{UP}[\w'’-]*\s+|\d{{1,3}}(?:st|nd|rd|th|ST|ND|RD|TH)\s+){{1,4}}?(?i:{STREET})\b\.?"
            rf"(?:,\s*(?i:apt|apartment|unit|suite|ste|flat|floor)\.?\s*#?\w+)?(?:,\s*{UP}[\w'’-]*(?:\s{UP}[\w'’-]*)*(?:\s\d{{4,5}})?)?",
        ),
        # street name with its kind attached or behind, then the house number
        (
            GERMAN,
            r"(?<![\w-])(?:St\.)?[^\W\d_][\w-]*(?:straße|strasse|str\.|weg|gasse|allee|platz|ufer|damm)\s+\d{1,4}[a-z]?\b(?:,\s*\d{5}\s+[^\W\d_][\w'’-]*(?:\s[A-Z][\w'’-]*)?)?",
        ),
        (
            0,
            rf"(?<![\w.,/:-])\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse|cours)\s+(?:(?:du|des|de\sla|de|d['’])\s?)?(?:St\.\s)?{UP}[\w'’-]*(?:\s{UP}[\w'’-]*)*",
        ),
        (
            SPANISH,
            rf"(?<!\w)(?:[Cc]alle|[Aa]venida|[Aa]vda\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Vv]ia|[Vv]iale)\s+(?:(?:de\sla|del|de|la|las|los)\s)?(?:St\.\s)?{UP}[\w'’-]*(?:\s(?:{UP}|\d)[\w'’-]*)*?,?\s+\d{{1,4}}\b",
        ),
        (
            BOX,
            r"(?<!\w)(?i:p\.?\s?o\.?\s?box|postfach|apartado|boîte\spostale|post\soffice\sbox)\s+\d{1,6}\b",
        ),
    )
)

ID_VALUE = r"(?:[A-Z]{1,2}\d{5,9}\b|\d{2}-\d{4}-[A-Z]\b|\d{3}(?P<sep>[-. ])\d{2}(?P=sep)\d{4}\b|\d{3} \d{3} \d{3}\b|\d{9}\b|\d{5,12}(?:-\d{2,4})?[A-Z]?\b|\d{2,4}(?:[- ]\d{2,6}){1,3}[A-Z]?\b)"
ID = re.compile(
    r"(?<![\w])(?i:(?:social\ssecurity|s\.?s\.?n\b\.?|ss\s?#|tax\s(?:id|identification)|tin\b|mrn\b|medical\srecord|health\srecord|hospital\s(?:no|number)|"
    r"patient\s(?:id|no|number)|chart|record|passport|reisepass|driver'?s?\slicen[cs]e|driving\slicen[cs]e|licen[cs]e|identity\scard|id\scard|national\sid(?:entity)?|"
    r"personalausweis|carte\sd['’]identité|insurance\s(?:member|policy)?|membership|member|policy|health\splan|dni\b|nie\b|nif\b|nhs\b|nino\b|curp\b|ni\sno)"
    r"(?:\s?(?:number|no\b|nr\b|num\b|id\b|card))?[\s.:#№=/-]{0,4}(?:is\s)?)"
    rf"(?P<id>{ID_VALUE})"
)
SSN = re.compile(r"\d{3}-\d{2}-\d{4}(?<![\w.,/-].{11})(?![\w-])")

EXT = r"(?:\s?(?:ext|x|extension|apparat|poste)\.?\s?\d{1,5})?"
PHONE = re.compile(
    rf"(?<![\w.,/+#-])(?:"
    rf"\+\d{{1,3}}[\s.-]?(?:\(0?\d{{0,4}}\)\s?)?\d{{1,5}}(?:[\s./-]\d{{2,5}}){{1,5}}{EXT}"
    rf"|\+\d{{8,14}}"
    rf"|(?:00\d{{1,2}}|1)[\s.-]\(?\d{{3}}\)?[\s.-]\d{{3}}[\s.-]\d{{4}}{EXT}"
    rf"|00\d{{2}}[\s.-]\d{{1,4}}(?:[\s.-]\d{{2,4}}){{2,4}}"
    rf"|\(\d{{3,5}}\)\s?\d{{3,4}}[\s.-]?\d{{3,4}}{EXT}"
    rf"|\d{{3}}([\s.-])\d{{3}}\1\d{{4}}{EXT}"
    rf"|0\d{{2,4}}\s\d{{3,4}}\s\d{{3,4}}"
    rf"|0\d(?:[\s.-]\d{{2}}){{4}}"
    rf"|0\d{{2,4}}/\d{{3,8}}(?:-\d{{1,5}})?"
    rf"|[2-9]\d{{2}}[2-9]\d{{6}}"
    rf"|[2-9]\d{{2}}-\d{{4}}"
    rf")(?![\w-]|[.,/]\d)"
)

PARTICLE = r"(?:(?:van|von|zu|de|del|della|di|da|dos|das|do|la|le|du|der|den|ter|ten|bin|ibn|al|el|st|mc|mac|af|av)\b[\s'’-]\s?)"
PART = rf"(?:{PARTICLE}{{0,3}}(?:[dDlLO]['’])?(?:(?i:al|el)-)?{UP}[\w'’]*(?:-{UP}?[\w'’]+)*)"
INITIAL = rf"(?:{UP}\.(?:-?{UP}\.)*)"
FULL = rf"(?:{PART},\s{PART}(?:\s(?:{PART}|{INITIAL}))?|(?:{INITIAL}\s)?(?:{PART}\s(?:{INITIAL}\s)?)?(?:{PART}\s)?{PART}|{INITIAL}\s{PART})"
#: Capitalised words that start or end no name: closed classes of words, titles, labels of forms.
NOT_NAMES = frozenset(
    (
        "The A An On In At After Before By No Not If It He She They We You I My His Her Our Your This That These Those There Here When While With Without "
        "From For To And Or But As Of Since During Because So Then Later Again Overall Meanwhile Also Only Each Both Some Any All One Two Three "
        "Is Was Were Are Be Been Has Had Have Does Did Will May Can "
        "Patient Reporter Carer Guardian Contact Room Ward Level Form Note Addendum NB Ref Tel Telephone Phone Fax Mail Email Mobile Home Address Please "
        "ID Identity Passport Chart Record Driver Driving Licence License Insurance Medical Social Tax Member Membership Policy MRN SSN DNI NIE NIF RN MD "
        "Dr Prof Mr Mrs Ms Nurse Frau Herr Don Monsieur Madame Mme Sra Sr M La Le El Der Die Das"
    ).split()
)
INSTITUTION = (
    r"(?:Hospital|Clinic|Klinik|Centre|Center|General|Wing|Ward|Protocol|Score|Scale|Index|University|Institute|Infirmary|Surgery|Pharmacy|Laborator(?:y|ies)|"
    r"GmbH|Inc|Ltd|AG|SA|Corp|Company|Pharma|disease|syndrome|phenomenon|palsy|catheter|test|sign|reflex|score|scale|protocol|clinic|hospital|method|criteria|stain)"
)
INSTITUTE, INSTITUTE_AFTER, INITIALS = re.compile(INSTITUTION), re.compile(rf"\s+(?:{UP}[\w'’-]*\s+)?{INSTITUTION}\b"), re.compile(INITIAL)
TITLE = r"(?:Mr|Mrs|Ms|Miss|Mx|Dr|Drs|Prof|Professor|Doctor|Sir|Herr|Frau|Fr|Monsieur|Madame|Mme|Mlle|Don|Doña|Sr|Sra|Srta|Dra|Señor|Señora|Signor|Signora|Nurse|Sister|Rev|Pr)"
TITLED = re.compile(TITLE)
KIN = r"(?:brother|sister|mother|father|son|daughter|wife|husband|aunt|uncle|cousin|friend|partner|neighbour|neighbor|grandmother|grandfather|carer|niece|nephew)"
BEFORE = re.compile(
    rf"(?<!\w)(?=[A-Za-z])(?:(?<!-){TITLE}\.?\s+(?:{TITLE}\.?\s+)*"
    rf"|(?<![\w-])(?<!{UP}\.\s)(?<!\w\w\s)M\.\s+|(?<=[a-z\W\d]\s)(?<!{UP}[a-zß-ÿ]\s)M\.\s+"
    r"|(?<!\w)(?i:according\sto|spoke\s(?:with|to)|talked\s(?:with|to)|signed\sby|written\sby|reported\sby|completed\sby|witnessed\sby|next\sof\skin(?:\sis|:)?|contact(?:\sperson)?:|"
    r"guardian:|carer:|caller:|reporter:|informant:|parent:|patient:|(?:patient|full|first|last|family|given|reporter)?\s?name:|attn\.?:?|attention:|attending:?|ask\sfor|asked\sfor|"
    r"care\sof|c/o|on\sbehalf\sof|regards,|sincerely,|signed[:,]?|by\snurse|by\sdr\.?|my\sname\sis|i\sam|called)\s+"
    rf"|(?<!\w)(?i:reporter)\s+(?={UP})"
    rf"|(?<!\w)(?i:her|his|their|my|the\spatient's)\s{KIN}\s+(?={UP})"
    rf"|(?<!\w)(?i:the)\s(?:[a-z]+\s){{0,2}}[a-z]+,\s+(?=(?:{INITIAL}\s|{PARTICLE})?{UP})"
    rf"|(?<!\w)(?i:the)\s(?:[a-z]+\s){{0,2}}[a-z]+\s\((?=(?:{INITIAL}\s|{PARTICLE})?{UP}[^()]*,\s(?i:tel|phone|mobile|fax|e-?mail|born|aged)\b)"
    rf"|(?<!\w)On\s[\w-]+(?:\s\w+)?\sof\s[\w-]+(?:\s[a-z]+)?,\s+(?={PARTICLE}?{UP})"
    r")"
)
NAME_HERE = re.compile(FULL)
LOWER_NAME = re.compile(
    r"(?:[^\W\d_][\w'’-]+\s[^\W\d_][\w'’-]+\s[^\W\d_][\w'’-]+(?=[;,.\n]|\s+[A-Z]|\s*$)"
    r"|[^\W\d_][\w'’-]+,?\s(?:[^\W\d_]\.\s)?[^\W\d_][\w'’-]+|[^\W\d_]\.\s[^\W\d_][\w'’-]+)"
)
LOWER_CUE = re.compile(r"(?i:attn\.?:?|name:|attention:|signed:?,?|regards,|sincerely,)\s+$")
#: What follows a name: a verb of telling, or a bracket and such a verb.
TELLS = re.compile(
    r"\s(?=(?:reports?|reported|developed|describe[ds]|calls|called|state[ds]|says|said|told|recall(?:s|ed)|could\snot|gave\sthe|"
    r"confirmed|complain(?:s|ed)|mentioned|wrote|writes|asked\s(?:for|about|if)|agreed|noticed|telephoned|phoned|rang|lives\sat|resides|brought)\b"
    r"|\([^()]{0,40}(?:\([^()]*\)[^()]*)?\)\s(?:gave|reports|could|called|a\sappelé))"
)
NAMED = re.compile(rf"(?<![\w@.-])(?=[^a-z\W]|van\s|von\s|de[lrn]?\s|d[iau]\s|al-|el-|l[ae]\s|[dl]['’]){FULL}")
#: A word that may be part of a name, read backwards to its beginning.
PIECE = re.compile(rf"(?:{INITIAL}|(?:van|von|zu|de|del|della|di|da|dos|das|do|la|le|du|der|den|ter|ten|bin|ibn|al|el|st|mc|mac|af|av)|(?:[dDlLO]['’]|(?i:al|el)-)?{UP}[\w'’]*(?:-{UP}?[\w'’]+)*),?")


def ends_here(text: str, end: int) -> re.Match | None:
    """The longest name that ends at ``end``, as far back as words may be parts of one."""
    begins, at = [], end
    while at > 0:
        left = at
        while left > 0 and not text[left - 1].isspace():
            left -= 1
        word = text[left:at]
        inner = max(word.rfind("("), word.rfind("["), word.rfind('"')) + 1
        if not PIECE.fullmatch(word, inner) or at < end and word.endswith(",") and begins and len(begins) > 2:
            break
        begins.append(left + inner)
        if inner or left < 2 or not text[left - 1].isspace():
            break
        at = left - 1
    for start in reversed(begins):
        m = NAMED.match(text, start)
        if m and m.end() == end:
            return m
        m = NAMED.match(text[:end], start)
        if m and m.end() == end:
            return m
    return None


WORD = re.compile(r"[^\W\d_]+")
#: Where numbers begin: no form of a number or address begins elsewhere.
RUN = re.compile(r"[+(]|\d+")
#: First words of what the forms above begin with, and what they then may be.
STARTS: dict[str, int] = {}
for _bit, _words in (
    (SPANISH, "calle avenida avda plaza paseo camino via viale"),
    (BOX, "box postfach apartado postale"),
    (DOT, "dot"),
    (AT, "at"),
    (
        LABEL,
        "social s ssn ss tax tin mrn medical health hospital patient chart record passport reisepass driver drivers driving license licence identity "
        "id national personalausweis carte insurance membership member policy dni nie nif nhs nino curp ni",
    ),
    (
        CUE,
        "mr mrs ms miss mx dr drs prof professor doctor sir herr frau fr monsieur madame mme mlle don doña sr sra srta dra señor señora signor signora "
        "nurse sister rev pr m according spoke talked signed written reported completed witnessed next contact guardian carer caller reporter informant "
        "parent patient full first last family given name attn attention attending ask asked care c on regards sincerely by my i called her his their the",
    ),
):
    for _word in _words.split():
        STARTS[_word] = STARTS.get(_word, 0) | _bit


AT_SIGN = re.compile(r"@|[(\[][aA][tT][)\]]")


def _local(text: str, sign: int) -> int:
    """Where the word before an at sign begins."""
    i = sign - 1 if sign and text[sign - 1].isspace() else sign
    while i and (text[i - 1].isalnum() or text[i - 1] in "_.+-"):
        i -= 1
    return i


def _at(form: re.Pattern, text: str, places: list[int]) -> Iterator[re.Match]:
    """The matches of ``form`` that begin at one of ``places``, none within another."""
    end = 0
    for i in places:
        if i >= end and (m := form.match(text, i)):
            end = m.end()
            yield m


def mentions(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every mention, in order, none within another."""
    taken = bytearray(len(text))
    out: list[tuple[int, int, str]] = []

    def take(a: int, b: int, kind: str) -> bool:
        if b <= a or any(taken[a:b]):
            return False
        taken[a:b] = b"\1" * (b - a)
        out.append((a, b, kind))
        return True

    # one look at every word tells which forms can occur, and where labels and cues may begin
    held, labels, cues, ats = 0, [], [], []
    low = text.lower()
    low = low if len(low) == len(text) else text
    for m in WORD.finditer(low):
        if bits := STARTS.get(m[0]):
            held |= bits
            if bits & LABEL:
                labels.append(m.start())
            if bits & CUE:
                cues.append(m.start())
            if bits & AT:
                ats.append(m.start())
    heads: list[int] = []
    signs = {m.start() for m in AT_SIGN.finditer(text)} | set(ats if held & DOT else ())
    for m in _at(EMAIL, text, sorted({_local(text, i) for i in signs})):
        if take(m.start(), m.end(), "EMAIL"):
            heads.append(m.start())
    runs = [m.start() for m in RUN.finditer(text)]
    places = []
    for bit, form in ADDRESSES:
        if bit == 0:
            places += [m.span() for m in _at(form, text, runs)]
        elif bit is GERMAN and GERMAN.search(text) or bit is not GERMAN and held & bit:
            places += [m.span() for m in form.finditer(text)]
    for a, b in sorted(places):
        take(a, b, "ADDRESS")
    numbers = [(m.start(), *m.span("id")) for m in _at(ID, text, labels)] + [(m.start(), *m.span()) for m in _at(SSN, text, runs)]
    for head, a, b in sorted(numbers):
        if take(a, b, "ID"):
            heads.append(head)
    for m in _at(PHONE, text, runs):
        take(m.start(), m.end(), "PHONE")
    # a name, a comma, and an e-mail address or a labelled number
    for a in heads:
        if text[max(a - 2, 0) : a] == ", " and (n := ends_here(text, a - 2)) and (span := _name(text, n)):
            take(*span, "NAME")
    for m in _at(BEFORE, text, cues):
        a = m.end()
        if LOWER_CUE.search(m[0]) and not (NAME_HERE.match(text, a) and not text[a].islower()):
            n = LOWER_NAME.match(text, a)
        else:
            n = NAME_HERE.match(text, a)
        lower = n is not None and n.re is LOWER_NAME
        if n and (span := n.span() if lower else _name(text, n)):
            take(*span, "NAME")
    for m in TELLS.finditer(text):
        if (n := ends_here(text, m.start())) and (span := _name(text, n)):
            take(*span, "NAME")
    out.sort()
    return out


def _name(text: str, m: re.Match) -> tuple[int, int] | None:
    """The span of a name without words that are none at its ends; None if nothing is left."""
    a, b = m.span()
    words = [(a + w.start(), a + w.end(), w[0].strip(",.")) for w in re.finditer(r"\S+", text[a:b])]
    if INSTITUTE_AFTER.match(text, b) or any(INSTITUTE.fullmatch(w) for _, _, w in words):
        return None
    while words and words[-1][2] in NOT_NAMES:
        words.pop()
    # a title inside begins the name anew
    words = words[max((i for i, (_, _, w) in enumerate(words) if TITLED.fullmatch(w)), default=0) :]
    while words and words[0][2] in NOT_NAMES and not INITIALS.fullmatch(text, *words[0][:2]):
        words.pop(0)
    if not words or not any(len(w) > 1 for _, _, w in words):
        return None
    return words[0][0], words[-1][1] - (text[words[-1][1] - 1] == ",")


# pseudonyms


def _round(key: bytes, n: int, tweak: str, value: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{n}|{tweak}|{value}".encode(), digest_size=12, key=key).digest(), "big")


def permute(value: int, size: tuple[int, int], key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of range(size[0] * size[1]) by a Feistel network of ten rounds; ``back`` inverts it."""
    left, right = size
    a, b = divmod(value, right)
    for n in reversed(range(10)) if back else range(10):
        sign = -1 if back else 1
        if n % 2 == 0:
            a = (a + sign * _round(key, n, tweak, b)) % left
        else:
            b = (b + sign * _round(key, n, tweak, a)) % right
    return a * right + b


def permute_digits(digits: str, key: bytes, kind: str, back: bool = False) -> str:
    """Digits permuted among all strings of their length."""
    if not digits:
        return digits
    n = len(digits)
    size = (10 ** (n // 2), 10 ** (n - n // 2))
    return str(permute(int(digits), size, key, f"{kind}{n}", back)).zfill(n)


def _ssn(d: str, letter: str) -> bool:
    return len(d) == 9 and not letter and d[:3] not in ("000", "666") and d < "9" and d[3:5] != "00" and d[5:] != "0000"


def _mod11(d: str, letter: str) -> bool:
    return len(d) == 10 and not letter and sum(int(c) * w for c, w in zip(d, range(10, 0, -1))) % 11 == 0


def _mod23(d: str, letter: str) -> bool:
    return len(d) == 8 and letter == "TRWAGMYFPDXBNJZSQVHLCKE"[int(d) % 23]


def _dialled(d: str, letter: str) -> bool:
    return len(d) == 10 and d[0] > "1" and d[3] > "1"


#: Checks by kind: ranges of social security numbers, check digits of health numbers, check letters of identity cards, ranges of
#: ten-digit phone numbers. They look at digits and letters only, so one number is checked alike however it is spaced.
CHECKS = {"ID": (("ssn", _ssn), ("mod11", _mod11), ("mod23", _mod23)), "PHONE": (("dialled", _dialled),)}
COUNTRY = re.compile(r"\+\d{1,2}(?=[\s(.-])(?:[\s.-]?\(0\))?|00\d{1,2}(?=[\s.-])|1(?=[\s.-]\(?\d{3})")


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isascii() and c.isdigit())


def checked(text: str, kind: str) -> str | None:
    """The check that a number passes, or None."""
    m = COUNTRY.match(text) if kind == "PHONE" else None
    body = text[m.end() :] if m else text
    letter = "".join(c for c in body if c.isalpha())
    digits = _digits(body)
    return next((name for name, test in CHECKS[kind] if test(digits, letter)), None)


def permute_number(text: str, key: bytes, kind: str, back: bool = False) -> str:
    """A number in its own format: digits permuted, everything else kept, and a phone's country prefix kept too.

    A number that passes a check becomes one that passes it, any other one that doesn't: the permutation is walked on
    until that is so, which keeps it a permutation.
    """
    m = COUNTRY.match(text) if kind == "PHONE" else None
    keep = m.end() if m else 0
    body, why, now = text[keep:], checked(text, kind), _digits(text[keep:])
    while True:
        now = permute_digits(now, key, kind, back)
        digits = iter(now)
        new = text[:keep] + "".join(next(digits) if c.isascii() and c.isdigit() else c for c in body)
        if checked(new, kind) == why:
            return new


#: fixed values: names of the months in the languages of the texts
MONTHS = (
    ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
)
_SHORT = tuple(m[:3] for m in MONTHS[0])
#: Month by name in small letters: (number, list of its language, or None for the English ones cut to three letters).
MONTH = {n.lower(): (i + 1, names) for names in reversed(MONTHS) for i, n in enumerate(names)} | {n.lower(): (i + 1, None) for i, n in enumerate(_SHORT)} | {"sept": (9, None), "may": (5, MONTHS[0])}
_NAME = "|".join(sorted(MONTH, key=len, reverse=True))
DATE = re.compile(
    r"(?<![\w/.-])(?:(?P<iy>(?:19|20)\d{2})-(?P<im>\d{1,2})-(?P<id>\d{1,2})"
    r"|(?P<n1>\d{1,2})(?P<sep>[/.-])(?P<n2>\d{1,2})(?P=sep)(?P<ny>(?:19|20)\d{2}|\d{2})"
    r"|(?P<mm>\d{1,2})(?P<msep>[/-])(?P<my>(?:19|20)\d{2})"
    rf"|(?i:(?P<w1>{_NAME}))\b\.?\s+(?P<wd>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<wy>(?:19|20)\d{{2}})"
    rf"|(?P<xd>\d{{1,2}})(?:st|nd|rd|th|\.)?\s+(?:of\s+|de\s+)?(?i:(?P<w2>{_NAME}))\b\.?,?\s+(?:de\s+)?(?P<xy>(?:19|20)\d{{2}})"
    rf"|(?i:(?P<w3>{_NAME}))\b\.?\s+(?P<vy>(?:19|20)\d{{2}})"
    r"|(?i:born\s+in|year\s+of\s+birth:?)\s+(?P<by>(?:19|20)\d{2}))(?![\w/-]|\.\d)"
)
FIRST, DAYS = dt.date(1900, 1, 1), 73049  # the days of 1900 to 2099
#: A year of two digits is one of these hundred.
SHORT_YEARS = range(1930, 2030)


def _day(y: int, m: int, d: int) -> dt.date | None:
    try:
        return dt.date(y, m, d)
    except ValueError:
        return None


def _ordered(m: re.Match) -> tuple[str, dt.date | None]:
    """How the parts of a numeric date are ordered, and its day: day first where that is a date, else month first."""
    a, b, y = int(m["n1"]), int(m["n2"]), int(m["ny"])
    if len(m["ny"]) == 2:
        y = next(full for full in SHORT_YEARS if full % 100 == y)
    if day := _day(y, b, a):
        return "dmy", day
    return "mdy", _day(y, a, b)


def permute_date(day: dt.date, key: bytes, back: bool = False, fits=lambda day: True) -> dt.date:
    """A day permuted among those of two centuries that ``fits`` accepts; others are walked round again."""
    at = (day - FIRST).days
    while True:
        at = permute(at, (271, 270), key, "DATE", back)
        if at < DAYS and fits(FIRST + dt.timedelta(days=at)):
            return FIRST + dt.timedelta(days=at)


def _span(part: str, value: int) -> str:
    return f"{value:02d}" if len(part) == 2 else str(value)


def new_date(m: re.Match, key: bytes, back: bool = False) -> str | None:
    """A date as another one in its format, under the key; None if it is no day of the calendar.

    Equal days stay equal in any format of day, month and year. The first of its month stands for a month without a day, the
    first of January for a year alone. Parts written with two digits keep two; single ones may grow to two. A new month whose
    name two languages share may come back in the other one, as the same day.
    """

    def put(parts: list[tuple[str, str]]) -> str:
        out, at = "", m.start()
        for group, value in parts:
            out += m.string[at : m.start(group)] + value
            at = m.end(group)
        return out + m.string[at : m.end()]

    def month(group: str, number: int) -> tuple[str, str]:
        was = m[group]
        name = (MONTH[was.lower()][1] or _SHORT)[number - 1]
        return group, name.upper() if was.isupper() else name.capitalize() if was[0].isupper() else name.lower()

    if m["by"]:
        years = lambda day: day.month == day.day == 1
        return put([("by", str(permute_date(dt.date(int(m["by"]), 1, 1), key, back, years).year))])
    if m["my"] or m["vy"]:
        if m["my"] and not 1 <= int(m["mm"]) <= 12:
            return None
        number = int(m["mm"]) if m["my"] else MONTH[m["w3"].lower()][0]
        new = permute_date(dt.date(int(m["my"] or m["vy"]), number, 1), key, back, lambda day: day.day == 1)
        return put([("mm", _span(m["mm"], new.month)), ("my", str(new.year))] if m["my"] else [month("w3", new.month), ("vy", str(new.year))])
    if m["n1"]:
        order, day = _ordered(m)
        if day is None:
            return None
        short = len(m["ny"]) == 2
        # the new day must be read in the same order, and a short year be one of the hundred
        fits = lambda new: (order == "dmy" or new.day > 12) and (not short or new.year in SHORT_YEARS)
        new = permute_date(day, key, back, fits)
        a, b = (new.day, new.month) if order == "dmy" else (new.month, new.day)
        return put([("n1", _span(m["n1"], a)), ("n2", _span(m["n2"], b)), ("ny", f"{new.year % 100:02d}" if short else str(new.year))])
    if m["iy"]:
        day, parts = _day(int(m["iy"]), int(m["im"]), int(m["id"])), ("iy", "im", "id")
    elif m["w1"]:
        day, parts = _day(int(m["wy"]), MONTH[m["w1"].lower()][0], int(m["wd"])), ("w1", "wd", "wy")
    else:
        day, parts = _day(int(m["xy"]), MONTH[m["w2"].lower()][0], int(m["xd"])), ("xd", "w2", "xy")
    if day is None:
        return None
    new = permute_date(day, key, back)
    value = {"y": str(new.year), "m": f"{new.month:02d}"}
    return put([month(g, new.month) if g in ("w1", "w2") else (g, value["y"] if g.endswith("y") else _span(m[g], new.month if g == "im" else new.day)) for g in parts])


def tag(text: str, key: bytes) -> str:
    """A keyed tag of 80 bits; equal for texts that differ in case, spaces and the order of words only."""
    folded = " ".join(sorted(re.findall(r"\w+", text.lower())))
    return hashlib.blake2b(folded.encode(), digest_size=10, key=key).hexdigest()


def pseudonym(value: str, kind: str, key: bytes) -> str:
    return permute_number(value, key, kind) if kind in ("ID", "PHONE") else tag(value, key)


def redact(text: str, key: bytes) -> str:
    """The text with ``[KIND pseudonym]`` for each mention and ``[DATE ...]`` for each date outside them."""
    spans = mentions(text)
    covered = bytearray(len(text))
    parts: list[tuple[int, int, str]] = []
    for a, b, kind in spans:
        covered[a:b] = b"\1" * (b - a)
        parts.append((a, b, f"[{kind} {pseudonym(text[a:b], kind, key)}]"))
    for m in DATE.finditer(text):
        if not any(covered[m.start() : m.end()]):
            new = new_date(m, key)
            if new is None and len(m["ny"] or "full") == 2:
                continue  # three small numbers that are no date
            parts.append((*m.span(), f"[DATE {tag(m[0], key) if new is None else new}]"))
    out, at = [], 0
    for a, b, new in sorted(parts):
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


PLACEHOLDER = re.compile(r"\[(ID|PHONE|DATE) ([^\[\]]+)\]")


def restore(redacted: str, key: bytes) -> str:
    """The text with its numbers and dates given back; tags stay, they can't be undone."""

    def back(m: re.Match) -> str:
        kind, value = m[1], m[2]
        if kind != "DATE":
            return permute_number(value, key, kind, back=True)
        d = DATE.fullmatch(value)
        return (new_date(d, key, back=True) or m[0]) if d else m[0]

    return PLACEHOLDER.sub(back, redacted)


def _key(secret: str) -> bytes:
    if not secret:
        raise ValueError("pseudonyms need a secret")
    return hashlib.sha256(secret.encode()).digest()


def found(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """key, kind, start_at, end_at, checked (the check that a number passes) and pseudonym of every mention."""
    code = _key(secret)

    def make():
        def rows(k, t):
            for a, b, kind in mentions(t) if t else ():
                yield k, kind, a, b, checked(t[a:b], kind) if kind in CHECKS else None, pseudonym(t[a:b], kind, code)

        return rows

    schema = f"`{key}` long, kind string, start_at long, end_at long, checked string, pseudonym string"
    return flat_map(df, [F.col(key).cast("long"), text], make, schema).distinct()


def redacted(df: DataFrame, key: str, text: str, secret: str) -> DataFrame:
    """key and the text with placeholders, under the secret of the pseudonyms."""
    code = _key(secret)

    def make():
        def rows(k, t) -> Iterator[tuple]:
            yield k, redact(t, code) if t else t

        return rows

    return flat_map(df, [F.col(key).cast("long"), text], make, f"`{key}` long, `{text}` string").distinct()
