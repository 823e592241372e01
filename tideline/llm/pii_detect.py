"""Finding personal data in one text. Pure Python on the consistent form; `pii.py` runs it over tables.

Shapes that carry their own evidence (mail addresses, telephone formats, checksummed-looking register numbers, streets with
house numbers) are found anywhere; shapes that other numbers share (nine or ten bare digits) need a cue beside them.
Names are found by a lexicon of given names followed by a family name, and by cues around a personal name ("called X",
"signed by X", "X told us"), which also finds names that no list has."""

from __future__ import annotations

import re

from tideline.llm.textforms import consistent

TYPES = ("email", "phone", "id_number", "address", "name")

# --- fixed values: words that mark personal data ------------------------------------------------------------------
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|double|triple"
TITLES = "senator|deputy|judge|minister|commissioner|councillor|governor|mayor|secretary|president|doctor|professor|sir|dame|lord|lady|dr|mr|mrs|ms|miss|prof|gov|sen|rep|señor|señora|monsieur|madame|herr|frau"
PLACES = "landing|harbor|harbour|springs|heights|river|city|town|valley|beach|hills|island|park|county|university|institute|street|road|avenue|lane|square|bridge|council|commission|foundation|agency|union|trust|labs|energy|network|observatory|group|board|centre|center|authority"
STREET_AFTER = "street|st|avenue|ave|road|rd|lane|ln|drive|dr|boulevard|blvd|court|ct|square|sq|terrace|way|close|crescent|parade"
STREET_CLEAR = "blvd|boulevard|ave|avenue|rd|road|lane|ln"
STREET_BEFORE = "calle|avenida|avda|plaza|paseo|carrer|rua|travessa|rue|avenue|boulevard|allée|chemin|quai|place|viale|piazza|улица|ул|проспект|переулок"
STREET_JOINED = "straße|strasse|str|weg|gasse|platz|allee|ufer|damm|ring"
#: What stands before a person's name: naming, company, contact, kinship, introductions.
NAME_BEFORE = (
    "named|called|signed by|name is|name:|i am|i'm|neighbour|neighbor|next to|beside|met|contact|contacted|phoned|emailed|interviewed|thanked|asked|talk to|talked to|spoke to|spoke with|spoken to|spoken with|wrote to|listen to|listened to|works with|worked with|lives with|lived with|"
    "friend|colleague|boss|teacher|doctor|nurse|landlord|husband|wife|brother|sister|cousin|uncle|aunt|mother|father|"
    "mi vecino|mi vecina|nuestro vecino|nuestra vecina|mi amigo|mi amiga|me llamo|llama|mon ami|mon amie|mon voisin|ma voisine|je m'appelle|s'appelle|nommé|nommée|ich heiße|heißt|namens|mein nachbar|meine nachbarin|chamado|chamada|me chamo|меня зовут|зовут"
)
#: What stands after one: a person's doings, with the object or place that makes them a person's.
NAME_AFTER = (
    "told us|told me|told him|told her|told them|tells us|tells me|asked us|asked me|called us|called me|phoned us|phoned me|wrote to us|wrote to me|wrote me|emailed us|emailed me|counted them|counted it|counted us|saw it|saw them|saw us|saw me|heard it|heard us|found it|found them|found me|signed it|filmed it|filmed us|filmed them|recorded it|watched us|watched them|watched it|knows it|knows me|knows us|"
    "was fired|was hired|was arrested|was sacked|was injured|was there|got fired|got hired|got arrested|is married|was born|lives at|lives in|lives on|lived at|lived in|lived on|works at|works for|worked at|worked for|about it|that night|"
    "lo vio|lo dijo|lo contó|lo sabe|nos dijo|me dijo|nos contó|me contó|vive en|trabaja en|habite|travaille|m'a dit|nous a dit|wohnt|arbeitet|hat mir|hat uns"
)
ID_CUE = "\\bssn\\b|social security|social sec|her social|his social|my social|social is|insurance number|\\bnino\\b|ni number|national insurance|passport|pasaporte|passeport|reisepass|passaporte|паспорт|\\bdni\\b|\\bnie\\b|\\bnif\\b|licen[cs]e|permit no|id card|id number|identity|personalausweis|cédula|cpf|steuer-?id"
PHONE_CUE = "tel|phone|call|text|rang|ring|whatsapp|mobile|cell|dial|llama|llame|teléfono|telefono|sms|fax|handy|telefon|number is|appelle|appelez|ligue|звоните|тел|tonight|reach me|reach us"
# ------------------------------------------------------------------------------------------------------------------

_MAIL = re.compile(r"[\w][\w.+%-]*@(?:[\w-]+\.)+[a-z][\w-]+", re.I)
_AT = r"\s?(?:\(at\)|\[at\]|\{at\}|<at>|\(arroba\)|@)\s?|\s+at\s+"
_DOT = r"\s?(?:\(dot\)|\[dot\]|\{dot\}|<dot>|\(punto\))\s?|\s+dot\s+"
_MAIL_SPOKEN = re.compile(rf"[\w][\w.+%-]*(?:{_AT})(?:[\w-]+(?:{_DOT}|\.))+[a-z][\w-]+", re.I)
_MAIL_SPELT = re.compile(rf"(?:\(at\)|\[at\]|\{{at\}}|<at>|\(arroba\)|{_DOT})", re.I)
_DIGITS = re.compile(r"(?<![\w.,#€$£])(?:\+|00)?\(?\d(?:[\d ()/\-]|\.(?=\d)){5,20}\d(?![\w%]|[.,]\d)")
_PHONE_SHAPES = re.compile(
    r"\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,8}){1,4}"  # international
    r"|00\d{2,6}(?: \d{2,4}){1,5}|00\d{9,13}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|1?[-. ]?\d{3}([-. ])\d{3}\1\d{4}"  # North America
    r"|0\d{4} \d{3} \d{3}|0\d{3} \d{3} \d{4}|0\d{2} \d{4} \d{4}|07\d{3} \d{6}"
    r"|0\d{2,4}/\d{3,8}(?:-\d{1,5})?|0\d{2,4}[ -]\d{5,8}(?:-\d{1,4})?"
    r"|0\d(?:[ .]\d\d){4}"
)
_SPOKEN = re.compile(rf"\b(?:{DIGIT_WORDS})(?:[\s,\-]+(?:{DIGIT_WORDS})){{6,}}\b", re.I)
_SSN = re.compile(r"\d{3}([-. ])\d{2}\1\d{4}")
_REGISTER = re.compile(r"(?<![\w-])(?:[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D]|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|[A-Z]\d{3}-\d{4}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2})(?![\w-])")
_ID_CUE = re.compile(rf"(?:{ID_CUE})", re.I)
_ID_CUE_NEXT = re.compile(rf"(?:{ID_CUE})\D{{0,14}}$", re.I)
_ID_TOKEN = re.compile(r"(?<![\w-])(?=[A-Z0-9\-. ]*\d{3})[A-Z]{0,3}\d[A-Z0-9]*(?:[-. ]?[A-Z0-9]{2,}){0,4}(?![\w-])")
_PHONE_CUE = re.compile(rf"(?:\b(?:{PHONE_CUE})\b)", re.I)
_HINT_WORDS = re.compile(r"[^\W\d_]+")


def _first_words(phrases: str) -> frozenset[str]:
    """The first word of each phrase; where a text has none of them, no phrase stands in it."""
    return frozenset(_HINT_WORDS.findall(p)[0] for p in phrases.split("|"))


#: Words of which a text must have one for a pattern to be tried; taken from the patterns' own lists.
_BEFORE_WORDS, _AFTER_WORDS = _first_words(NAME_BEFORE), _first_words(NAME_AFTER)
_NAME_WORDS = _BEFORE_WORDS | _AFTER_WORDS
_CUE_WORDS = frozenset(_HINT_WORDS.findall(NAME_BEFORE)) - {"s"}
_STREET_WORDS, _STREET_ENDS = _first_words(f"{STREET_AFTER}|{STREET_BEFORE}|{STREET_CLEAR}"), tuple(STREET_JOINED.split("|"))
_ID_WORDS = frozenset("ssn social insurance nino ni national passport pasaporte passeport reisepass passaporte паспорт dni nie nif licence license permit id identity personalausweis cédula cpf steuer steuerid".split())
_NO = r"\d{1,4}(?: ?[a-zA-Z](?![\w]))?"
_CAP0 = r"[^\W\d_a-zà-öø-ÿ][\w'’\-]*"
_W = r"[^\W\d_][\w'’\-]*"
_STREET = re.compile(
    rf"(?<![\w.,])(?:(?:apt|flat|unit|suite|apartment)\.? ?\d+[a-z]?, ?)?{_NO},? (?:(?-i:{_CAP0}) ){{1,3}}(?:{STREET_AFTER})\b(?:\.(?=,))?(?:, {_W})?"
    rf"|(?<![\w.,]){_NO},? {_W} (?:{STREET_CLEAR})\b(?:\.(?=,))?(?:, {_W})?"
    rf"|(?<![\w.,]){_NO},? {_W} (?:{STREET_AFTER})\b(?=\s*(?:[.,;:!?\n]|$))"
    rf"|(?<![\w.,])\d{{1,4}}(?: ?(?:bis|ter))?,? (?:{STREET_BEFORE})\b\.?(?: (?:de|du|des|la|le|da|do|del))* {_W}(?:, {_W})?"
    rf"|\b(?:{STREET_BEFORE})\b\.?(?: (?:de|del|la|las|los|da|do|dos|du))* {_W}(?: {_W})?,? (?:n[º°.o]+ ?)?{_NO}(?:, \d{{1,2}}[º°ª](?: ?\w)?)?"
    rf"|\b{_W}(?:{STREET_JOINED})\.? {_NO}(?:, \d{{5}} {_W})?",
    re.I,
)
#: Words that a street's name doesn't have; they tell text in capitals from a capitalised name.
_NO_STREET = frozenset("on that of in to for against and about than by with".split())
_CAP = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]+(?:['’\-][^\W\d_]+)*"
_ANY = r"[^\W\d_]{2,}(?:['’\-][^\W\d_]{2,})*"
_PERSON = rf"(?:{_CAP},? (?:[^\W\d_a-z]\. ?)?{_CAP})"
_LOWER = rf"(?:{_ANY},? (?:[^\W\d_]\. ?)?{_ANY})"
_CUE_BEFORE = re.compile(rf"(?i:{NAME_BEFORE}):? (?:(?P<cap>{_PERSON})|(?P<low>{_LOWER}))")
_CUE_AFTER = re.compile(rf"(?:{NAME_AFTER})\b", re.I)
_PERSON_ENDS = re.compile(rf"\b(?:(?P<cap>{_PERSON})|(?P<low>{_LOWER})) \Z")
_ASK = re.compile(r"\b[Aa]sk \Z")
_TITLE = re.compile(rf"(?:{TITLES})\.?", re.I)
_PLACE = re.compile(rf"(?:{PLACES})", re.I)
_STOP = frozenset("the a an and or of in on at to for by with from as is was were be this that these those it he she they we you i my your our their his her its not no us me them who which what when where why how all any some more most only even just so if but about after before since than then there here very much many los las el la un una y o de del que en con por para se su es lo le les des du et ou à un une dans der die das und oder von zu mit auf für ist nicht ein eine ask told was said says say swears swore thinks thought claims claimed insists knows knew heard works lives call text tel meet tips check still source folks wow fact people everyone someone nobody".split())
_SENTENCE = (". ", "! ", "? ", "; ", ": ", "… ")
_WORDS = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")


def _is_person(given_family: str, given: frozenset[str], cue: bool, lower: bool) -> bool:
    parts = _WORDS.findall(given_family)
    if len(parts) < 2:
        return False
    low = [p.lower() for p in parts]
    if any(_TITLE.fullmatch(p) for p in parts[:-1]) or any(_PLACE.fullmatch(p) for p in parts[1:]) or low[0] in _STOP or low[-1] in _STOP or low[0] in _CUE_WORDS:
        return False
    if cue and not lower:
        return True
    return low[0] in given or low[-1] in given


def _name_spans(text: str, has: set[str], given: frozenset[str]) -> list[tuple[int, int]]:
    out = []
    if not _NAME_WORDS.isdisjoint(has):
        done = 0  # where the last name ends
        for word in _HINT_WORDS.finditer(text):
            w, at = word.group().lower(), word.start()
            if w in _BEFORE_WORDS and at >= done and (m := _CUE_BEFORE.match(text, at)):
                group = "cap" if m.group("cap") else "low"
                if _is_person(m.group(group), given, True, group == "low") or (group == "low" and _lower_pair(m.group(group))):
                    out.append(m.span(group))
                    done = m.end(group)
            if w in _AFTER_WORDS and _CUE_AFTER.match(text, at) and (m := _PERSON_ENDS.search(text, max(done, at - 90), at)):
                group = "cap" if m.group("cap") else "low"
                s, asked = m.start(group), bool(_ASK.search(text, max(0, m.start(group) - 4), m.start(group)))
                opens = asked or s == 0 or text[s - 2 : s] in _SENTENCE or text[s - 1] == "\n"
                if _is_person(m.group(group), given, True, group == "low") or (group == "low" and opens and _lower_pair(m.group(group))):
                    out.append(m.span(group))
                    done = m.end(group)
    # the lexicon: a known given name with a capitalised word beside it
    tokens = None
    if not given.isdisjoint(has):
        tokens = list(_WORDS.finditer(text))
        for i, m in enumerate(tokens):
            if m.group().lower() not in given or not m.group()[0].isupper():
                continue
            if i + 1 < len(tokens):
                n = tokens[i + 1]
                between = text[m.end() : n.start()]
                initial = len(n.group()) == 1 and n.group().isupper() and i + 2 < len(tokens) and text[n.end() : tokens[i + 2].start()] in (". ", ".")
                if initial and between == " ":
                    n = tokens[i + 2]
                    between = " "
                if between == " " and n.group()[0].isupper() and len(n.group()) > 2 and not _PLACE.fullmatch(n.group()) and n.group().lower() not in _STOP and not (i and _TITLE.fullmatch(n.group())) and not text.startswith("@", m.start() - 1):
                    out.append((m.start(), n.end()))
                    continue
            if i and text[tokens[i - 1].end() : m.start()] == ", " and tokens[i - 1].group()[0].isupper() and len(tokens[i - 1].group()) > 3:
                p = tokens[i - 1]
                sentence_start = p.start() == 0 or text[p.start() - 2 : p.start()] in (". ", "! ", "? ", "; ", ": ") or text[p.start() - 1] == "\n"
                if not sentence_start and p.group().lower() not in _STOP and not (i + 1 < len(tokens) and _PLACE.fullmatch(tokens[i + 1].group())):
                    out.append((p.start(), m.end()))
    return out


def _lower_pair(pair: str) -> bool:
    """A cue is followed by two lower-case words that are neither function words nor plain plurals: a name typed in lower case."""
    parts = _WORDS.findall(pair.lower())
    return len(parts) == 2 and all(p not in _STOP and p not in _CUE_WORDS and len(p) > 2 and not p.endswith("s") for p in parts) and bool(_FAMILY.search(parts[1]) or _FAMILY.search(parts[0]))


#: Endings of family names of many countries; only used for names typed in lower case after a cue.
_FAMILY = re.compile(
    r"(?:son|sson|sen|man|mann|berg|burg|stein|feld|bach|hoff|dorf|quist|gren|ström|ström|dahl|gaard|by|ford|ton|ham|ley|wood|field|well|worth|ridge|stone|brook|shaw|ell|ert|ard|eau|ault|ier|aro|ini|ino|ano|elli|etti|ucci|ez|eira|eiro|inho|escu|idis|akis|poulos|ovic|ovich|evic|ić|ič|ski|ska|wski|cki|czyk|ak|ova|eva|enko|chuk|yan|oğlu)$"
)


def find(text: str | None, given: frozenset[str] = frozenset()) -> list[tuple[str, int, int]]:
    """(type, start, end) of each piece in ``text``, which must be in consistent form; pieces do not overlap, earlier types win."""
    if not text:
        return []
    low = text.lower()
    has = set(_HINT_WORDS.findall(low))
    raw: list[tuple[str, int, int]] = []
    if "@" in text:
        raw += [("email", *m.span()) for m in _MAIL.finditer(text)]
    if ("at" in has or "arroba" in has) and _MAIL_SPELT.search(low):
        raw += [("email", *m.span()) for m in _MAIL_SPOKEN.finditer(text) if _MAIL_SPELT.search(m.group())]
    hints = not _ID_WORDS.isdisjoint(has)
    for m in _DIGITS.finditer(text):
        s, e = m.span()
        piece = text[s:e].strip()
        n = sum(c.isdigit() for c in piece)
        before = low[max(0, s - 28) : s]
        if hints and 7 <= n <= 14 and _ID_CUE_NEXT.search(before) and not _PHONE_CUE.search(before[-10:]):
            if e < len(text) and text[e] == "-" and e + 1 < len(text) and text[e + 1].isalpha():
                continue  # the letter belongs to it; _REGISTER has it
            raw.append(("id_number", s, e))
        elif _SSN.fullmatch(piece):
            raw.append(("id_number", s, e))
        elif _PHONE_SHAPES.fullmatch(piece) and 7 <= n <= 15:
            raw.append(("phone", s, e))
        elif 9 <= n <= 13 and piece.isdigit() and _PHONE_CUE.search(low[max(0, s - 14) : s] + " | " + low[e : e + 10]):
            raw.append(("phone", s, e))
    raw += [("phone", *m.span()) for m in _SPOKEN.finditer(text)]
    raw += [("id_number", *m.span()) for m in _REGISTER.finditer(text)]
    if hints:
        for cue in _ID_CUE.finditer(text):
            m = _ID_TOKEN.search(text, cue.end(), cue.end() + 40)
            if m and m.start() - cue.end() <= 16 and sum(c.isdigit() for c in m.group()) >= 5 and not re.search(r"[.;!?]\s", text[cue.end() : m.start()].replace("no. ", "no ")):
                raw.append(("id_number", *m.span()))
    if not _STREET_WORDS.isdisjoint(has) or any(w.endswith(_STREET_ENDS) for w in has):
        raw += [("address", *m.span()) for m in _STREET.finditer(text) if _NO_STREET.isdisjoint(m.group().lower().split())]
    names = _name_spans(text, has, given)
    raw.sort(key=lambda x: (TYPES.index(x[0]), x[1], -x[2]))
    raw += [("name", s, e) for s, e in names]
    out: list[tuple[str, int, int]] = []
    for kind, s, e in raw:
        if all(e <= a or s >= b for _, a, b in out):
            out.append((kind, s, e))
    return sorted(out, key=lambda x: x[1])


def entity(kind: str, piece: str) -> str:
    """What the piece refers to, whatever its spelling: the key of coreference."""
    low = consistent(piece).lower()
    if kind == "email":
        low = re.sub(_AT, "@", low, count=1)
        return re.sub(r"\s", "", re.sub(_DOT, ".", low))
    if kind == "phone":
        value = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
        out, times = "", 1
        for token in re.findall(r"\d|\+|[a-z]+", low):
            if token in ("double", "triple"):
                times = 2 if token == "double" else 3
                continue
            out += value.get(token, token if not token.isalpha() else "") * times
            times = 1
        return re.sub(r"^(?:\+|00)", "", out)
    if kind == "id_number":
        return re.sub(r"[^a-z0-9]", "", low)
    if kind == "name":
        if "," in low:
            family, _, given = low.partition(",")
            low = f"{given.strip()} {family.strip()}"
        return re.sub(r"\s+\w\.\s*", " ", low).strip()
    return re.sub(r"\W+", " ", low).strip()
