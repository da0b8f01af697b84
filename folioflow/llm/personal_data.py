"""Problem 5: personal values in free text, and typed placeholders in their place.

Values are looked for in the consistent form of the text (``visible_form``), so
that wide digits, thin spaces or unseen characters don't hide them, and are
reported at their offsets in the text as stored. One pass over the words and one
over the stretches of digits say where a value can be; only there are patterns
tried. Numbers are recognised by their formats, by what they are called, and by
their check digits where a number without separators has no other sign; they are
left alone after words such as "Order" or "Version". Names are recognised by
what stands before and after them, by titles and by common given names; a name
once recognised is then found wherever else its note has it. Dates are personal
only as dates of birth: those get the placeholder BIRTH_DATE.

A value is replaced by "[TYPE pseudonym]". The pseudonym is made by a keyed
Feistel network over the value's own format (``pseudonyms``), so a number still
looks like one, validated numbers stay valid, dates stay dates, and equal values
get equal pseudonyms in all documents. The key has no default.

Defined cases: null text gives no findings and a null result; an empty text
stays empty. Rows delivered twice give equal findings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows
from .pseudonyms import Feistel, scheme_of
from .text_quality import COMMON
from .visible_form import Transducer, default_transducer

# Words by which letters in several languages name people, streets and numbers.
TITLES = (
    "Mr Mrs Ms Mx Miss Dr Prof Sir Madam Herr Herrn Frau Fräulein Mme Mlle Me Monsieur Madame Mademoiselle Maître Sr Sra Srta "
    "Señor Señora Señorita Dra Don Doña Sig Signor Signora Dott Dottor Dottoressa Mevrouw Mevr Dhr Senhor Senhora Doutor Doutora "
    "señora señor"
)
PARTICLES = "van von de del della di da dos du der den la le ten ter zu zur af av"
SPELLED = (
    "zero one two three four five six seven eight nine oh null eins zwei drei vier fünf sechs sieben acht neun zéro un deux trois quatre "
    "cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve due tre quattro cinque sei sette otto nove nul een twee drie "
    "vijf zes zeven negen um dois três quatro sete oito"
)
NOT_A_VALUE = (
    "batch order serial version invoice ratio section ticket part lot ref reference case item model sku isbn issn page charge bestellung "
    "rechnung seriennummer version auftrag commande facture lot série pedido factura lote serie ordine fattura bestelling factuur build release"
)

_T = r"(?:(?:" + "|".join(sorted(set(TITLES.split()), key=lambda x: -len(x))) + r")\b\.?\s+){1,2}"
_L = r"[^\W\d_]"
_W = rf"{_L}{{2,}}(?:-{_L}+)*"
_SUR = rf"(?:\b(?:{'|'.join(PARTICLES.split())})[ \t]+){{0,2}}(?:[oOdDlL]['’])?{_W}"
#: "Surname, Given", "Given Surname", "G. Surname" or one of them.
_N = rf"(?:{_SUR}, (?:{_W}|{_L}\.)|(?:(?:{_W}|{_L}\.)[ ])?{_SUR})"
_NAME = re.compile(_N, re.I)

#: Patterns of names by the words that they begin with.
_CUED = (
    ("dear hello hi sehr liebe lieber estimado estimada querido querida chère chèr cher geachte beste gentile caro cara prezado prezada", rf"(?:Dear|Hello|Hi|Sehr geehrte[rs]?|Lieber?|Estimad[oa]s?|Querid[oa]|Chère?|Geachte|Beste|Gentile|Car[oa]|Prezad[oa])\s+(?:{_T})?(?P<n>{_N})\s*[,:!]"),
    ("madame monsieur mademoiselle", rf"(?:Madame|Monsieur|Mademoiselle)\s+(?P<n>{_N})\s*,"),
    (
        "regards sincerely faithfully truly wishes grüßen grüsse grüße cordialement salutations à atentamente saludo saludos saluti groet groeten groete cumprimentos",
        rf"(?:regards|sincerely|faithfully|truly|wishes|Grüßen|Grüsse|Grüße|Cordialement|salutations|à vous|Atentamente|saludos?|saluti|groeten?|groet|cumprimentos),?[ ]*\n\s*(?:{_T})?(?P<n>{_N})",
    ),
    (
        "witnessed signed issued ausgestellt au nombre intestato intestata op em parcels message call",
        rf"(?:witnessed by|signed by|issued to|ausgestellt auf|au nom de|a nombre de|intestat[oa] a|op naam van|em nome de|Parcels for|message for|call for)\s+(?:{_T})?(?P<n>{_N})",
    ),
    ("her his their my your our", rf"(?:Her|His|Their|My|Your|Our) (?:mother|father|sister|brother|wife|husband|partner|son|daughter|neighbour),\s+(?:{_T})?(?P<n>{_N}),"),
    ("applicant claimant tenant patient customer", rf"(?:applicant|claimant|tenant|patient|customer)\s+\((?:{_T})?(?P<n>{_N}),"),
    ("contact", rf"Contact:\s+(?:{_T})?(?P<n>{_N}),"),
    ("according laut selon según secondo volgens segundo", rf"(?:According to|Laut|Selon|Según|Secondo|Volgens|Segundo)\s+(?:{_T})?(?P<n>{_N})(?=,| wohnt| lebt| vive| woont| mora)"),
)
_BULLETED = re.compile(rf"(?:^|(?<=\s))[-*•]\s+(?:{_T})?(?P<n>{_N})\s+[—–-]\s+(?=[+(\d]|(?:{'|'.join(sorted(set(SPELLED.split())))})\b|plus\b)", re.I)
#: By first word: (rank among the patterns, pattern). Names that several patterns meet go to the first of them.
_NAMED: dict[str, list[tuple[int, re.Pattern]]] = {}
for _rank, (_words, _pattern) in enumerate(_CUED):
    for _w in _words.split():
        _NAMED.setdefault(_w, []).append((_rank, re.compile(_pattern, re.I)))
#: Words that are not the first of their pattern, and the characters before them.
_BACK = {"nombre": 2}
#: What follows a name; the name is looked for in the characters before it.
_AFTER = re.compile(r"\s(?:asked us\b|wrote:|ist unter\b|est joignable\b|atiende\b|è raggiungibile\b|is bereikbaar\b|atende\b)", re.I)
_AFTER_WORDS = frozenset("asked wrote ist est atiende è is atende".split())
_ENDING = re.compile(rf"(?<!\w)(?:{_T})?(?P<n>{_N})$", re.I)
_WINDOW = 80
#: After these words "M." is a title and not the first letter of a name.
_SIR = re.compile(r"\b(?:selon|monsieur|cher)\s+$", re.I)
_TITLED = re.compile(r"(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Herrn?|Frau|Mme|Mlle|Sra|Srta|Sr|Dra|Monsieur|Madame|Señora?|Sig|Dott|Mevrouw|Senhora?)\b\.?\s+(?P<n>" + _N + ")")
_TITLED_WORDS = frozenset("Mr Mrs Ms Mx Miss Dr Prof Herr Herrn Frau Mme Mlle Sra Srta Sr Dra Monsieur Madame Señor Señora Sig Dott Mevrouw Senhor Senhora".split())
_TITLE_WORD = re.compile(rf"(?:(?:{'|'.join(sorted(set(TITLES.split()), key=lambda x: -len(x)))})\b\.?\s+)+", re.I)
# Common given names, which make a capitalised word after them a name.
GIVEN = frozenset(
    "James John Robert Michael David William Richard Thomas Peter Paul Andrew George Mary Patricia Jennifer Linda Elizabeth Susan Sarah Karen Emma Alice Anna Hans Jürgen Klaus Wolfgang Dieter Heinz Stefan Ursula "
    "Monika Petra Sabine Katharina Pierre Jean Michel Philippe Jacques Marie Isabelle Sophie Camille Nathalie José Juan Carlos Luis Javier Miguel Antonio Carmen Isabel Pilar Lucía Elena Giuseppe Giovanni Mario "
    "Luigi Francesco Maria Giulia Chiara Francesca Jan Pieter Kees Willem Johannes Anneke Marieke João Pedro Paulo Ana Fernanda Beatriz Ahmed Mohammed Fatima Ivan Olga Natalia".split()
)
_GIVEN = re.compile(rf"(?P<n>[^\W\d_]+(?:[ ]{_L}\.)?[ ](?:(?:{'|'.join(PARTICLES.split())})[ ]){{0,2}}(?-i:[^\W\d_a-zà-öø-ÿ]){_L}+(?:-{_L}+)*)")
#: Words after a given name that make it the name of a firm or a street.
_FIRMS = "foundry textiles optics partners ltd inc gmbh ag company brothers sons group bank press hotel hospital university school institute church day"
#: Where a date of birth is given.
_BORN = re.compile(
    r"\b(?:born(?: on)?|date of birth|birth date|DOB|geboren(?: am| op)?|Geburtsdatum|geb\.|née? le|date de naissance|nacid[oa] el|fecha de nacimiento|nat[oa] il|data di nascita|geboortedatum|nascid[oa] em|data de nascimento)"
    r"[ :]{0,3}(?P<v>\d{4}-\d{1,2}-\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{4})(?!\d)",
    re.I,
)
_BORN_WORDS = frozenset("born birth dob geboren geburtsdatum geb né née naissance nacido nacida nacimiento nato nata nascita geboortedatum nascido nascida nascimento".split())

#: What joins the two parts of an address, and the part after it; the part before is read backwards.
_AT = re.compile(r"@\s?|\s?(?:\(at\)|\[at\]|\{at\})\s?| at (?=[\w-]{1,63}(?: dot |\s?[(\[{]dot))", re.I)
_SIGN, _SPELT = re.compile(r"@\s?"), re.compile(r"[(\[{]at[)\]}]| dot |[(\[{]dot", re.I)
_LABEL = r"[^\W_](?:[\w-]{0,61}[^\W_])?"
_DOT = r"(?:\.|\s?[(\[{]dot[)\]}]\s?| dot )"
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL}){{0,8}}{_DOT}[A-Za-z]{{2,24}}", re.I)

_D = r"(?<![\w/.,-])"
_E = r"(?![\w/]|[.,-]\d|-\w)"
_PHONES = [
    re.compile(p)
    for p in (
        r"(?<![\w+])\+\s?\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}" + _E,
        _D + r"00[1-9]\d{0,2}[ .-]?(?:\(0\)[ .-]?)?\d(?:[ .-]?\d){6,11}" + _E,
        r"(?<!\w)\(0?\d{2,4}\)[ ]?\d{3,4}[ .-]?\d{3,5}" + _E,
        _D + r"0\d{2,4}/\d{5,9}" + _E,
        _D + r"0\d{3,4} \d{6}" + _E,
        _D + r"0[1-9]0? \d{4} \d{4}" + _E,
        _D + r"0\d(?:[ .]\d{2}){4}" + _E,
        _D + r"0\d{9,10}" + _E,
        _D + r"[2-9]\d{2}[-.]\d{3}[-.]\d{4}" + _E,
        _D + r"[2-9]\d{2}-\d{4}" + _E,
        _D + r"\d{3}(?: \d{2}){3}" + _E,
        _D + r"[69]\d{2} \d{3} \d{3}" + _E,
    )
]
_SPELLED = frozenset(SPELLED.split())
#: Digit words spoken one after the other make a number from so many on.
_LEAST_SPOKEN = 7

_IDS = [
    re.compile(p, re.I)
    for p in (
        _D + r"\d{3}[-–]\d{2}[-–]\d{4}" + _E,
        _D + r"\d{2}/\d{3}/\d{5}" + _E,
        _D + r"\d{2} \d{2} \d{2} ?/ ?\d{3,4}" + _E,
        _D + r"\d{6}/\d{4}" + _E,
        r"(?<![\w-])[A-Z][-–] ?\d{3} ?\d{3} ?\d{3}" + _E,
        r"(?<![\w-])[A-CEGHJ-PRSTWXYQ][A-CEGHJ-NPRSTWXYZQ] ?\d{2} ?\d{2} ?\d{2} ?[A-D]" + _E,
        r"(?<![\w-])[A-Z]\d[A-Z]\d{6}" + _E,
        r"(?<![\w-])\d{8}[-–]?[A-Z]" + _E,
        r"(?<![\w-])[XYZ][-–]?\d{7}[-–]?[A-Z]" + _E,
    )
]
_ANY_NUMBER = re.compile("|".join(f"(?:{p.pattern})" for p in (*_IDS, *_PHONES)), re.I)
#: Digits with what may stand between and around them in a number; numbers are looked for in those of six digits or more.
_STRETCH = re.compile(r"\d(?:[\d ./()–-]|[A-Za-z] ?\d)*(?:[-– ]?[A-Za-z])?")
#: Letters and marks of a number that may stand before its first digit.
_AHEAD = 6
#: Characters of the shortest of them from its first digit on.
_LONG = 10
#: The rank of numbers by their check digits: after all formats.
_LAST = len(_IDS) + len(_PHONES)
#: Numbers whose check digits alone say what they are.
_BY_CHECK = re.compile(r"(?<![\w.,/-])(?:\d{3}\.\d{3}\.\d{3}-\d{2}|[12] ?\d{2} ?\d{2} ?\d{2} ?\d{3} ?\d{3} ?\d{2}|[A-Z]{6}\d{2}[A-Z]\d{2}[A-Z]\d{3}[A-Z])(?![\w/]|[.,-]\d)")
_ID_CUE = re.compile(
    r"(?:\bID|\bPassport|\bpassport (?:no\.?|number)|\bAusweisnummer|\bReisepass|\bPersonalausweis|\bPièce d['’]identité|\bPasseport|\bDocumento|\bPasaporte|\bDNI|\bNIF|\bNINO|\bSSN|\bIdentity checked against|\bCarta d['’]identità|\bPaspoort)"
    r"(?: (?:no|nr|number|n°)\.?)?:? +(?P<v>(?=[\w /.–-]*\d{2})[A-Z0-9](?:[A-Z0-9]|[ /–-]{1,3}(?=[A-Z0-9])){5,17})(?![\w])"
)

_CITY = r"[^\W\d_][\w'’-]*"
#: Patterns of streets by the words that they begin with (or end with, with the characters to look back).
_STREETS: dict[str, list[tuple[int, int, re.Pattern]]] = {}
_STREET_ENDS: dict[str, list[tuple[int, int, re.Pattern]]] = {}
for _rank, (_words, _back, _pattern, _flags) in enumerate(
    (
        ("street road lane avenue crescent quay mews row boulevard terrace gardens", 120, r"(?:\b(?:Flat|Apt\.?|Apartment|Suite|Unit) \w{1,4},?\s+)?(?<![\w.,-])\d{1,4}[a-z]?\s+(?:[^\W\d_][\w'’-]*\s+){1,2}(?:Street|Road|Lane|Avenue|Crescent|Quay|Mews|Row|Boulevard|Terrace|Gardens)\b", re.I),
        ("st rd ln ave cres blvd square sq drive court ct place pl way close walk hill", 120, r"(?:\b(?:Flat|Apt\.?|Apartment|Suite|Unit) \w{1,4},?\s+)?(?<![\w.,-])\d{1,4}[A-Za-z]?\s+(?:[A-ZÀ-Þ][\w'’-]*\s+){1,2}(?:St|Rd|Ln|Ave|Cres|Blvd|Square|Sq|Drive|Court|Ct|Place|Pl|Way|Close|Walk|Hill|ST|RD|LN|AVE)\b\.?", 0),
        ("box postfach postale apartado postbus postal", 16, r"\b(?:P\.?\s?O\.?\s?Box|Postfach|Bo[iî]te postale|Apartado(?: de correos)?|Casella postale|Postbus|Caixa postal)\s+\d{1,6}", re.I),
        ("rue avenue boulevard quai allée allee impasse chemin place cours route square passage", 20, r"(?<![\w.,/-])\d{1,4}(?:\s?(?:bis|ter|quater|[a-d])\b)?,?\s+(?:rue|avenue|boulevard|quai|all[ée]e|impasse|chemin|place|cours|route|square|passage)\s+(?:(?:du|de|des|la|le|les)\s+|[dl]['’])*[^\W\d_][\w'’-]*", re.I),
        ("*straße *strasse *str *gasse *weg *platz *allee *ufer *damm *ring", -1, r"\b[^\W\d_][\w-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ufer|damm|ring)\s+\d{1,4}\s?[a-z]?\b(?:/\d+)?", re.I),
        ("am an im in zum zur auf unter", 0, r"\b(?:Am|An der|An den|Im|In der|Zum|Zur|Auf dem|Auf der|Unter den|AM|AN DER|IM|ZUM|ZUR)\s+[A-ZÄÖÜ][\w-]+\s+\d{1,4}[a-zA-Z]?(?:/\d+)?(?=,?\s+\d{4,5}\s)", 0),
        ("calle c avda avenida plaza paseo camino ronda travesía travesia via viale piazza corso largo rua praça travessa", 0, r"\b(?:Calle|C/|Avda\.?|Avenida|Plaza|Paseo|Camino|Ronda|Traves[ií]a|Via|Viale|Piazza|Corso|Largo|Rua|Praça|Travessa)\s+(?:[^\W\d_][\w'’.-]*\s+){0,4}[^\W\d_][\w'’-]*,?\s+\d{1,4}\b", re.I),
        ("*straat *laan *gracht *plein *kade *dijk *singel", -1, r"\b[^\W\d_][\w-]*(?:straat|laan|gracht|plein|kade|dijk|singel)\s+\d{1,4}\s?[a-z]?\b", re.I),
    )
):
    for _w in _words.split():
        (_STREET_ENDS if _w[0] == "*" else _STREETS).setdefault(_w.lstrip("*")[-4:] if _w[0] == "*" else _w, []).append((_rank, _back, re.compile(_pattern, _flags)))
_STREET_ENDS = {k: list(dict.fromkeys(v)) for k, v in _STREET_ENDS.items()}
_PLACE_REST = re.compile(
    rf"(?:,?\s+(?:Unit|Flat|Apt\.?)\s+\w{{1,4}}\b)?(?:,?\s+\d+\.?[ºª°]\s?\w?)?(?:,?\s+\d{{4,5}}\s+{_CITY}(?:[ -][A-ZÀ-Þ]{_CITY})?|,\s+(?-i:[A-ZÀ-Þ]){_CITY}(?:[ -](?-i:[A-ZÀ-Þ])[\w'’-]*)?(?:\s+\d{{4,5}}\b)?)?",
    re.I,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_BEFORE = re.compile(r"([^\W\d_]+)\.?(?:\s+(?:no|nr|number|n°|n\.º|#)\.?)?[ :#]*$", re.I)
_NOT = frozenset(NOT_A_VALUE.split())
_PARTICLES = frozenset(PARTICLES.split())
#: Words that begin a street only with a capital.
_CAPITAL = frozenset("am an im in zum zur auf unter".split())
_NO_SURNAME = frozenset([*_STREETS, *_FIRMS.split()])
_ID_WORDS = frozenset("id passport ausweisnummer reisepass personalausweis pièce passeport documento pasaporte dni nif nino ssn identity carta paspoort".split())
#: Every word that begins a pattern or counts in one, so that most words cost one look-up.
_CUES = frozenset([*_NAMED, *_STREETS, *_AFTER_WORDS, *_BORN_WORDS, *_ID_WORDS, *_SPELLED, *(w.lower() for w in (*_TITLED_WORDS, *GIVEN))])
#: Words that stand where a name could, but are none.
_NO_NAME = frozenset(
    "minutes protokoll protocole compte rendu acta verbale verslag ata sir madam team all colleagues customer tenant applicant damen herren "
    "kolleginnen kollegen mesdames messieurs señores señoras clientes everyone section contact further copy kept later go goes asked lives wrote mit freundlichen kind regards cordialement merci ref atentamente saludos section".split()
) | (COMMON - frozenset(PARTICLES.split()) - frozenset(x.lower() for x in TITLES.split()))


def _is_name(name: str) -> bool:
    words = [w.lower() for w in _WORD.findall(name)]
    return bool(words) and not any(w in _NO_NAME for w in words if len(w) > 1) and any(len(w) > 2 for w in words)


_DATE = re.compile(r"\d{1,2}[./ -]\d{1,2}[./ -]\d{4}|\d{4}[./ -]\d{1,2}[./ -]\d{1,2}")


def _is_date(v: str) -> bool:
    return bool(_DATE.fullmatch(v.strip()))


def _numbers(form: str) -> Iterator[tuple[int, int, int, str]]:
    """(rank, start, end, type) of what has the format of a number of a person or of a telephone."""
    for s in _STRETCH.finditer(form):
        near = s[0]
        if len(near) < _AHEAD or _DATE.fullmatch(near.strip(" .,-–")):
            continue
        a, b = max(0, s.start() - _AHEAD), min(len(form), s.end() + 4)
        for m in _BY_CHECK.finditer(form, a, b) if len(near) >= _LONG else ():
            if scheme_of(re.sub(r"\W", "", m[0])) is not None:
                yield _LAST, m.start(), m.end(), "IDENTITY_DATA"
        if not _ANY_NUMBER.search(form, a, b):
            continue
        for rank, p in enumerate(_IDS):
            for m in p.finditer(form, a, b):
                yield rank, m.start(), m.end(), "IDENTITY_DATA"
        for rank, p in enumerate(_PHONES, len(_IDS)):
            for m in p.finditer(form, a, b):
                if 7 <= sum(map(str.isdigit, m[0])) <= 15 and not _is_date(m[0]):
                    yield rank, m.start(), m.end(), "PHONE"


def _addresses(form: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses, looked for around what joins their parts."""
    for m in (_AT if _SPELT.search(form) else _SIGN).finditer(form):
        a = m.start()
        while a and (form[a - 1].isalnum() or form[a - 1] in "_.%+-"):
            a -= 1
        while a < m.start() and not form[a].isalnum():
            a += 1
        if a < m.start() and (form[m.start() - 1].isalnum() or form[m.start() - 1] == "_"):
            rest = _DOMAIN.match(form, m.end())
            if rest:
                yield a, rest.end()


def find_values(text: str, transducer: Transducer) -> list[tuple[int, int, str]]:
    """(start, end, type) of the personal values of a text, in order, without overlaps."""
    form, offsets = transducer.with_offsets(text)
    taken = bytearray(len(form))
    found: list[tuple[int, int, str]] = []

    def add(a: int, b: int, kind: str) -> bool:
        while b > a and form[b - 1].isspace():
            b -= 1
        if b <= a or taken.find(1, a, b) >= 0:
            return False
        taken[a:b] = b"\1" * (b - a)
        found.append((a, b, kind))
        return True

    def word_before(at: int) -> str:
        m = _BEFORE.search(form[max(0, at - 30) : at])
        return m[1].lower() if m else ""

    # The words, and where those stand that a name or a street can begin, end or be told by.
    low = form.lower()
    if len(low) != len(form):
        low = form
    tokens = list(_WORD.finditer(low))
    words = [m[0].lower() for m in tokens] if low is form else [m[0] for m in tokens]
    marked = [i for i, w in enumerate(words) if w in _CUES or w[-4:] in _STREET_ENDS or w[-3:] in _STREET_ENDS]
    names_at: list[tuple[int, int, re.Pattern]] = []
    streets_at: list[tuple[int, int, int, re.Pattern]] = []
    titled_at: list[int] = []
    id_at: list[int] = []
    given_at: list[int] = []
    after_at: list[int] = []
    born = False
    spoken, run, before = [], 0, -2
    for i in marked:
        w, (a, b) = words[i], tokens[i].span()
        for rank, p in _NAMED.get(w, ()):
            names_at.append((rank, max(0, a - _BACK.get(w, 0)), p))
        for rank, back, p in _STREETS.get(w, ()) if form[a].isupper() or w not in _CAPITAL else ():
            streets_at.append((rank, a - back, b + 2 if back else a, p))
        for rank, _, p in _STREET_ENDS.get(w[-4:]) or _STREET_ENDS.get(w[-3:], ()):
            streets_at.append((rank, a, a, p))
        if w in _AFTER_WORDS and a and _AFTER.match(form, a - 1):
            after_at.append(a - 1)
        born = born or w in _BORN_WORDS
        if w in _ID_WORDS:
            id_at.append(a)
        if w in _SPELLED:
            # Digit words with nothing but blanks and hyphens between them.
            run = run + 1 if before == i - 1 and not form[tokens[i - 1].end() : a].strip(" \t\r\n-") else 1
            before = i
            if run == _LEAST_SPOKEN:
                spoken.append([i - run + 1, i])
            elif run > _LEAST_SPOKEN:
                spoken[-1][1] = i
        if form[a].isupper():
            if form[a:b] in _TITLED_WORDS:
                titled_at.append(a)
            if form[a:b] in GIVEN:
                given_at.append(a)

    for a, b in _addresses(form):
        add(a, b, "EMAIL")
    for m in _BORN.finditer(form) if born else ():
        add(*m.span("v"), "BIRTH_DATE")
    for m in filter(None, (_ID_CUE.match(form, a) for a in id_at)):
        v = m["v"].rstrip(" /-")
        if sum(c.isdigit() for c in v) >= 5 and not _is_date(v):
            add(m.start("v"), m.start("v") + len(v), "IDENTITY_DATA")
    for _, a, b, kind in sorted(_numbers(form)):
        if word_before(a) not in _NOT:
            add(a, b, kind)
    for first, last in spoken:
        a = tokens[first].start()
        if first and words[first - 1] == "plus" and form[tokens[first - 1].end() : a].isspace():
            a = tokens[first - 1].start()
        add(a, tokens[last].end(), "PHONE")

    names: set[str] = set()

    def person(a: int, b: int) -> None:
        t = _TITLE_WORD.match(form, a, b)
        if t and t.end() < b:
            a = t.end()
        name = form[a:b]
        if name.startswith("M. ") and _SIR.search(form[max(0, a - 12) : a]):
            a += 3
            name = name[3:]
        # A name of more than one word that ends in an ordinary word ends before it.
        while not _is_name(name) and " " in name:
            name = name.rsplit(" ", 1)[0].rstrip(",")
        if _is_name(name) and add(a, a + len(name), "PERSON"):
            names.update(w.lower() for w in _WORD.findall(name) if len(w) > 3 or w[:1].isupper() and len(w) > 2)

    names_at.sort(key=lambda x: x[:2])
    for rank, a, p in names_at:
        if rank == 1 and form[:a].rstrip(" >")[-1:] not in ("", "\n", "."):
            continue
        m = p.match(form, a)
        if m:
            person(*m.span("n"))
    if " - " in form or " – " in form or " — " in form:
        for m in _BULLETED.finditer(form):
            person(*m.span("n"))
    for cue in after_at:
        at = max(0, cue - _WINDOW)
        m = _ENDING.search(form[at:cue])
        if m:
            person(at + m.start("n"), at + m.end("n"))
    for a in titled_at:
        m = _TITLED.match(form, a)
        if m and (m["n"][:1].isupper() or m["n"].split()[0].lower() in _PARTICLES):
            person(*m.span("n"))
    # A place ends where a name begins.
    streets_at.sort(key=lambda x: x[:2])
    for rank, lo, hi, p in streets_at:
        for m in (p.match(form, hi),) if lo == hi else p.finditer(form, max(0, lo), len(form) if rank == 3 else hi):
            if m:
                rest = _PLACE_REST.match(form, m.end())
                end = rest.end() if rest else m.end()
                met = taken.find(1, m.start(), end)
                if met < 0 or met >= m.end():
                    end = end if met < 0 else met
                    add(m.start(), m.start() + len(form[m.start() : end].rstrip(" ,\n")), "LOCATION")
            if rank == 3:
                break
    for a in given_at:
        m = _GIVEN.match(form, a)
        if m and m["n"].rsplit(None, 1)[-1].lower() not in _NO_SURNAME:
            person(*m.span("n"))
    names -= _PARTICLES
    if names:
        last = -1
        for i in [i for i, w in enumerate(words) if w in names]:
            w, (a, end) = words[i], tokens[i].span()
            if a >= last and not taken[a] and (form[a].isupper() or len(w) > 4):
                full = _NAME.match(form, a)
                if full and all(w.lower() in names or w.lower() in _PARTICLES for w in _WORD.findall(full[0])):
                    end = full.end()
                add(a, end, "PERSON")
                last = end
    found.sort()
    return [(offsets[a], offsets[b - 1] + 1, k) for a, b, k in found]


# ---- pseudonyms -----------------------------------------------------------

def canonical_value(value: str, kind: str) -> str:
    """One writing for values that are the same however written: the base of the pseudonym."""
    v = " ".join(value.split())
    if kind == "PHONE":
        return re.sub(r"[^\d+]", "", v) or v.lower()
    if kind == "EMAIL":
        v = re.sub(r"\s*[(\[{]at[)\]}]\s*", "@", v, flags=re.I)
        return re.sub(r"\s*[(\[{]dot[)\]}]\s*", ".", v, flags=re.I).replace("@ ", "@").lower()
    if kind == "PERSON":
        if "," in v:
            v = " ".join(x.strip() for x in reversed(v.split(",", 1)))
        return v.title()
    if kind == "IDENTITY_DATA":
        return re.sub(r"[\W_]", "", v).upper()
    if kind == "BIRTH_DATE":
        d = [x.zfill(2) for x in re.split(r"[./-]", v)]
        return "-".join(d if len(d[0]) == 4 else reversed(d))
    return v


FINDING_DDL = "placeholder string, start_pos int, end_pos int, value string, pseudonym string"


def _pseudonyms(key: bytes) -> Callable[[str, str], str]:
    """The pseudonym of a value and its type; values that return are permuted once."""
    cipher = Feistel(key)

    @lru_cache(maxsize=1 << 16)
    def of(v: str, kind: str) -> str:
        if kind == "LOCATION":
            # Places have no format of their own: a tag of eight letters, permuted from their hash.
            v = "".join(chr(97 + b % 26) for b in hashlib.sha256(v.lower().encode("utf-8", "replace")).digest()[:8])
        return cipher.encrypt(v, kind)

    return lambda value, kind: of(canonical_value(value, kind), kind)


def find_personal_data(df: DataFrame, id_col: str, text_col: str, key: bytes) -> DataFrame:
    """A row of FINDING_DDL for each place of a personal value."""
    src = df.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).cast("string").alias("body")).filter("body <> ''")

    def make():
        t, pseudonym = default_transducer(), _pseudonyms(key)

        def fn(cols):
            out: dict[str, list] = {n: [] for n in ("key", "placeholder", "start_pos", "end_pos", "value", "pseudonym")}
            for k, body in zip(cols["key"], cols["body"]):
                for a, b, kind in find_values(body, t):
                    for n, v in zip(out, (k, kind, a, b, body[a:b], pseudonym(t.with_offsets(body[a:b])[0], kind))):
                        out[n].append(v)
            return out

        return fn

    return map_rows(src, make, f"key bigint, {FINDING_DDL}").withColumnRenamed("key", id_col)


def redact_personal_data(df: DataFrame, id_col: str, text_col: str, key: bytes) -> DataFrame:
    """(id_col, redacted_text, n_values): each text with typed placeholders in place of its values."""
    src = df.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).cast("string").alias("body"))

    def make():
        t, pseudonym = default_transducer(), _pseudonyms(key)

        def fn(cols):
            texts, counts = [], []
            for body in cols["body"]:
                if body is None:
                    texts.append(None)
                    counts.append(0)
                    continue
                parts, at = [], 0
                found = find_values(body, t)
                for a, b, kind in found:
                    parts += [body[at:a], f"[{kind} {pseudonym(t.with_offsets(body[a:b])[0], kind)}]"]
                    at = b
                texts.append("".join([*parts, body[at:]]))
                counts.append(len(found))
            return {"key": cols["key"], "redacted_text": texts, "n_values": counts}

        return fn

    return map_rows(src, make, "key bigint, redacted_text string, n_values int").withColumnRenamed("key", id_col)
