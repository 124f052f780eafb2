"""Personal information in free text: e-mail addresses, phone and identity numbers, street addresses, names.

Method: a semi-Markov conditional random field.  Every kind has spans of bounded length proposed around what such a
segment needs (digits, an at sign, a street word, a word of the name lexicon).  A span is scored as a whole by its
form and its surroundings, a transition by the kind of the segment before it.  Dynamic programming over the spans
sums all ways to cut a text (the partition function, for fitting by likelihood) or finds the best one (for finding),
so boundaries and kinds are decided together.  Text between segments scores nothing.  The weights are fitted on
labelled texts made by :mod:`verdigris.llm.personal_grammar`, which knows nothing of the documents; names also use a
lexicon drawn from all documents.

Everything here is plain Python and numpy; :mod:`verdigris.llm.personal_spark` applies it to tables.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict

import numpy as np

KINDS = ("email", "phone", "identity", "address", "name")
_NUMBER_OF = {k: i for i, k in enumerate(KINDS)}
#: Longest segment of each kind, in characters.
LONGEST = {"email": 120, "phone": 40, "identity": 32, "address": 90, "name": 70}

# Words for streets, units and house numbers in the languages of the data and some of their neighbours.
STREET_WORDS = "Street St Road Rd Avenue Ave Lane Ln Way Row Terrace Parade Drive Dr Boulevard Blvd Court Ct Close Square Sq Quay Crescent Cres Mews Place Pl Walk Grove Gardens Hill Park Alley Circle Highway Hwy Straße Weg Gasse"
STREET_ENDS = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm", "berg", "steig", "straat", "laan", "plein", "gracht", "gatan", "vägen", "gata", "gade", "vej", "veien", "utca")
STREET_STARTS = "rue avenue av boulevard bd chemin place impasse quai allée route cours calle c/ avda avenida plaza paseo camino ronda carrera travesía via viale piazza corso vicolo largo rua travessa praça alameda estrada ul ulica al aleja pl plac os улица ул проспект пр переулок пер бульвар бул площадь пл вулиця вул просп пров шоссе наб набережная провулок"
UNIT_WORDS = "flat apt apartment unit suite room appt appartement bât étage porte hinterhaus vorderhaus whg wohnung og stock bajo ático entresuelo piso interno int scala m mieszkanie кв квартира корп оф подъезд"
HOUSE_WORDS = "bis ter quater д дом буд будинок nr no n num № n.º n.° nº"
GERMAN_PLACES = "am an auf im zum zur unter"
DIRECTIONS = "n s e w ne nw se sw north south east west"
#: Abbreviations that keep their dot inside an address; any other word with a dot ends a sentence.
DOTTED = set("st rd ave ln dr blvd ct sq cres pl hwy av bd avda ul al os ул пр пер бул пл вул просп пров наб д буд корп кв оф apt appt bât int n nr num no w e s str whg m c og".split())
SMALL_WORDS = "de du des la le les der den die das dem del della delle dei di da do dos das van von of the l d"
_STREET = {w.lower() for w in STREET_WORDS.split()}
_CLASS_OF = {w: c for words, c in ((SMALL_WORDS, "l"), (DIRECTIONS, "D"), (GERMAN_PLACES, "K"), (HOUSE_WORDS, "B"), (UNIT_WORDS, "U"), (STREET_STARTS, "P")) for w in words.split()}
_WAYS = "SPQGK"

_PLACE_TOKEN = re.compile(r"\d+(?:/\d+)?(?:[^\W\d_](?![^\W_]))?|[Cc]/|[Nn]\.?\s?[º°]|[^\W\d_]+(?:['’-][^\W\d_]+)*\.?|\S")
# How at and dot are spelled out.
_AT = re.compile(r"\s?[\[({<]\s?(?:at|ät|arroba|собака|@)\s?[\])}>]\s?|\s?[@＠]\s?|\s(?:at|arroba|собака)\s(?=\S+\s(?:dot|punkt|punto|point|точка)\s)", re.I)
_DOT = r"(?:\s?[\[({<]\s?(?i:dot|punkt|punto|point|точка|\.)\s?[\])}>]\s?|\.|\s(?i:dot|punkt|punto|point|точка)\s)"
_DOTS = re.compile(_DOT)
_LOCAL = re.compile(r"[\w][\w.+'-]*\Z")
_DOMAIN = re.compile(rf"[\w-]+(?:{_DOT}[\w-]+)+")
_EMAIL_HINT = re.compile(r"[@＠]|\b(?:at|ät|arroba|собака)\b", re.I)
_GROUP = re.compile(r"[^\W_]+")
_LINK = re.compile(r"[\s().\-/–‑+№#:,]{1,4}")
_WORDY = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*|[☎№]")
_SIX_DIGITS = re.compile(r"\d(?:\D{0,5}\d){5}")
_EXTENSIONS = ("ext", "x", "доб", "extension", "int", "poste")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*\.?|\d+|\S")
#: A word of prose: not part of an address, an identifier or a number.
_FREE_WORD = re.compile(r"(?<![\w.@+/=-])[^\W\d_]+(?:['’-][^\W\d_]+)*(?![\w@+=]|[.-]\w|\s?[\[({]\s?at\b|\s@)")
_SPACE = r"[ \t   ]+"
# Small words inside names.
_PARTICLE = r"(?:van|von|de|del|della|da|dos|di|der|den|ten|ter|zu|zum|bin|ibn|al|el|la|le|af|y)"
_NAME = re.compile(rf"(?=(?<![\w@.'’/+=-])(?P<a>[^\W\d_]\.|[^\W\d_]{{2,}}(?:['’-][^\W\d_]+)*|[^\W\d_]['’][^\W\d_]+(?:-[^\W\d_]+)*)(?P<s>,?{_SPACE})(?:(?P<m>[^\W\d_]\.|{_PARTICLE}(?:{_SPACE}{_PARTICLE})?){_SPACE})?(?P<b>[^\W\d_]\.|[^\W\d_]['’][^\W\d_]+(?:-[^\W\d_]+)*|[^\W\d_]{{2,}}(?:['’-][^\W\d_]+)*)(?![\w@'’]|\.\w|-\w))")
_THIRD = re.compile(rf"{_SPACE}([^\W\d_]{{2,}}(?:['’-][^\W\d_]+)*)(?![\w@'’]|\.\w|-\w)")


class Lexicon:
    """Given and family names in lower case: listed ones, and ones learned from their company."""

    def __init__(self, given, family, more_given=(), more_family=(), common=()):
        self.of: dict[str, str] = {}
        for words, mark in ((common, "c"), (more_given, "g"), (more_family, "f"), (given, "G"), (family, "F")):
            for w in words:
                self.of[w.lower()] = mark

    def mark(self, word: str) -> str:
        if word.endswith(".") and len(word) == 2:
            return "I"
        return self.of.get(word.lower(), "u")


def company(texts, listed) -> tuple[Counter, Counter, Counter]:
    """Pairs of capitalised words that stand together as given and family name, and how often each word is written
    with a capital and small."""
    pairs, large, small = Counter(), Counter(), Counter()
    for text in texts:
        for m in _FREE_WORD.finditer(text):
            w = m.group(0)
            (large if w[0].isupper() else small)[w.lower()] += 1
        for m in _NAME.finditer(text):
            a, b = m["a"], m["b"]
            if a[0].isupper() and b[0].isupper() and not a.endswith(".") and not b.endswith("."):
                if "," not in m["s"]:
                    pairs[a.lower(), b.lower()] += 1
                elif a.lower() in listed:  # a salutation and a given name are no family name and given name
                    pairs[b.lower(), a.lower()] += 1
    return pairs, large, small


def learn_lexicon(texts, given, family, least: int = 2, rounds: int = 2) -> Lexicon:
    """The listed names and those that stand beside them, at least ``least`` times beside different partners.

    Words that are written small in a fifth of their uses or more are common words, not names.
    """
    g, f = {w.lower() for w in given}, {w.lower() for w in family}
    listed = g | f
    pairs, large, small = company(texts, listed)
    common = {w for w, n in small.items() if n >= 0.2 * (n + large[w])}
    for _ in range(rounds):
        firsts, lasts = defaultdict(set), defaultdict(set)
        for a, b in pairs:
            if a in g:
                lasts[b].add(a)
            if b in f:
                firsts[a].add(b)
        f |= {w for w, by in lasts.items() if len(by) >= least and w not in common and w not in g}
        g |= {w for w, by in firsts.items() if len(by) >= least and w not in common and w not in f}
    return Lexicon(given, family, g - listed, f - listed, common - listed)


# ---------------------------------------------------------------- spans
#
# A span is (start, end, kind, key, context).  What the key says is scored once for each distinct key; ``context``
# are features in named slots, at most one value of each slot, so that the most a context can add is known.


class _Shapes(dict):
    """Digits as 9, capitals as A, small letters as a, blanks and dashes as one."""

    def __missing__(self, code):
        ch = chr(code)
        out = "9" if ch.isdigit() else ("A" if ch.isupper() else "a") if ch.isalpha() else " " if ch.isspace() else "-" if ch in "–‑" else ch
        self[code] = out
        return out


_SHAPES = _Shapes()


def shape(s: str) -> str:
    """Digits as 9 (a leading zero or eight of the first group kept), capitals as A, small letters as a, blanks as one."""
    out = s.translate(_SHAPES)
    at = out.find("9")
    return out[:at] + s[at] + out[at + 1 :] if at >= 0 and s[at] in "08" else out


def number_features(form: str) -> list[str]:
    """What a shape says about a phone or identity number: the whole form, and its parts for forms never seen."""
    groups = re.findall(r"[^\W_]+", form)
    between = re.findall(r"[\W_]+", form.strip("(+"))
    digits = sum(c in "089" for c in form)
    letters = "".join(re.sub(r"[089]+", "9", g) for g in groups if any(c.isalpha() for c in g))
    lead = "+" if form.startswith(("+", "(+")) else "00" if form.startswith("0") and groups[0] in ("0099", "009") else "(" if form[0] == "(" else form[0] if form[0] in "08" else "A" if form[0] == "A" else "9"
    lengths = ".".join(str(len(g)) for g in groups)
    return [
        f"form:{form}", f"plain:{form.replace('0', '9').replace('8', '9')}", f"digits:{digits}", f"lead:{lead}", f"lead:{lead}:{digits}", f"groups:{len(groups)}", f"lengths:{lengths}",
        f"between:{''.join(sorted(set(''.join(between))))}", f"letters:{letters}", f"letters:{letters}:{digits}", f"last:{len(groups[-1])}", f"first:{len(groups[0])}", f"lead:{lead}:groups:{len(groups)}", f"long:{max(map(len, groups))}:{len(groups) == 1}",
        f"small:{sum(len(g) < 2 for g in groups)}", f"even:{len(set(map(len, groups)))}",
    ]


def address_features(key: str) -> list[str]:
    pattern, _, last = key.partition("|")
    around = f"^{pattern}$"
    return [f"pattern:{pattern}", f"last:{last}", f"n:{len(pattern)}", *(f"two:{around[i : i + 2]}" for i in range(len(around) - 1)), *(f"three:{around[i : i + 3]}" for i in range(len(around) - 2))]


def name_features(key: str) -> list[str]:
    order, case = key.split("|")
    return [f"order:{order}", f"case:{case}", f"order:{order}:{case}"]


def email_features(key: str) -> list[str]:
    return key.split("|")


_FEATURES = {"email": email_features, "phone": number_features, "identity": number_features, "address": address_features, "name": name_features}


def _always(kind: str, key: str) -> bool:
    return True


def _emails(line: str, at: int, keep, out: list):
    for m in _AT.finditer(line):
        local = _LOCAL.search(line, max(0, m.start() - 64), m.start())
        domain = _DOMAIN.match(line, m.end())
        if not local or not domain:
            continue
        sign = m.group(0)
        dots = [d.start() + domain.start() for d in _DOTS.finditer(domain.group(0))]
        for e in [*dots[1:6], domain.end()]:
            labels = [x for x in _DOTS.split(line[domain.start() : e])]
            last = labels[-1]
            key = "|".join([f"last{min(len(last), 4)}", f"alpha{last.isalpha()}", f"under{any('_' in x for x in labels)}", f"spaced{sign != sign.strip()}", f"sign{'@' in sign or '＠' in sign}", f"labels{min(len(labels), 4)}", f"case{last.isupper() == local.group(0).isupper()}", f"single{last.isupper() and len(last) == 1}", f"spaced{sign != sign.strip()}{len(labels)}{local.group(0).isidentifier()}"])
            if e - local.start() <= LONGEST["email"] and keep("email", key):
                out.append((at + local.start(), at + e, "email", key, [f"whole={e == domain.end()}", *_sides(line, local.start(), e)]))


def _numbers(line: str, at: int, keep, out: list):
    groups = [(g.start(), g.end(), g.group(0)) for g in _GROUP.finditer(line)]
    n, fits, digits, linked = len(groups), [], [], []
    for i, (_, e, w) in enumerate(groups):
        d = sum(map(str.isdigit, w)) if len(w) <= 20 else 99
        digits.append(d)
        fits.append(0 < d < 99 or (len(w) <= 6 and w.isupper()) or w in _EXTENSIONS)
        gap = line[e : groups[i + 1][0]] if i + 1 < n else ""
        linked.append(0 < len(gap) <= 4 and _LINK.fullmatch(gap) is not None)
    for i in range(n):
        if not fits[i] or (not digits[i] and groups[i][2] in _EXTENSIONS):
            continue
        low = groups[i][0]
        while low > 0 and line[low - 1] in "(+":
            low -= 1
        total = letters = 0
        for j in range(i, min(n, i + 10)):
            if not fits[j] or (j > i and not linked[j - 1]):
                break
            total += digits[j]
            high = groups[j][1]
            if total > 18 or high - low > 40:
                break
            word = groups[j][2]
            letters += len(word) > digits[j] and word not in _EXTENSIONS
            if total < 6 or not digits[j] and not word.isupper():
                continue
            span = line[low:high]
            if span.count("(") != span.count(")") or (total == 6 and span.isdigit()):
                continue
            phone_form = shape(span)
            for kind, form in (("phone", phone_form), ("identity", phone_form.replace("0", "9").replace("8", "9"))):
                if (letters if kind == "phone" else span[0] in "(+" or "(" in span or high - low > LONGEST["identity"]) or not keep(kind, form):
                    continue
                left = i > 0 and linked[i - 1] and (digits[i - 1] > 0) and low == groups[i][0]
                right = j + 1 < n and linked[j] and digits[j + 1] > 0
                cue = _cue(line, low)
                out.append((at + low, at + high, kind, form, [f"cue={cue}", f"beside={left}{right}", f"form={cue}:{form}", *_sides(line, low, high)]))


def _places(line: str, at: int, keep, out: list):
    tokens = [(m.start(), m.end(), m.group(0)) for m in _PLACE_TOKEN.finditer(line)]
    classes = [_place_class(w) for _, _, w in tokens]
    # words in small letters that belong to no address, and full stops, are not inside one
    closed = [c in "xw" for c in classes]
    stops = [w[-1] == "." and len(w) > 1 and w[:-1].lower() not in DOTTED and not w.lower().endswith("str.") for _, _, w in tokens]
    if not any(c in _WAYS for c in classes) or "N" not in classes:
        return
    seen = set()
    for w, c in enumerate(classes):
        if c not in _WAYS:
            continue
        for a in range(max(0, w - 7), w + 1):
            if classes[a] not in "NUCGPQKD" or any(closed[a:w]) or any(stops[a:w]):
                continue
            for b in range(w, min(len(tokens), w + 10)):
                if closed[b] or (b > w and stops[b - 1]):
                    break
                if (a, b) in seen or classes[b] not in "NSQAUPGC":
                    continue
                seen.add((a, b))
                inside = "".join(classes[a : b + 1])
                if "N" not in inside:
                    continue
                s, e, last = tokens[a][0], tokens[b][1], tokens[b][2].lower()
                if e - s > LONGEST["address"]:
                    break
                named = last.rstrip(".") if classes[b] in "SQPUG" else ""
                for dot in (False, True) if last.endswith(".") and not stops[b] else (False,):
                    key = f"{inside}|{named}{'.' if dot else ''}"
                    if keep("address", key):
                        end = e if dot or not last.endswith(".") else e - 1
                        after = "".join(classes[b + 1 : b + 3]) if dot or not last.endswith(".") else "." + "".join(classes[b + 1 : b + 2])
                        out.append((at + s, at + end, "address", key, [f"follow={after or '$'}", f"next={(classes[b + 1 : b + 2] or ['$'])[0]}", f"prev={classes[a - 1] if a else '^'}", *_sides(line, s, end)]))


def _place_class(w: str) -> str:
    if w[0].isdigit():
        return "N" if len(w.partition("/")[0]) <= 5 else "M"
    low = w.lower()
    bare = low.rstrip(".")
    if bare in _STREET:
        return ("Q" if bare in _CLASS_OF else "S") if w[0].isupper() else _CLASS_OF.get(bare, "w")
    if bare in _CLASS_OF:
        return "w" if _CLASS_OF[bare] == "K" and not w[0].isupper() else _CLASS_OF[bare]
    if low in _CLASS_OF:
        return _CLASS_OF[low]
    if not w[0].isalpha():
        return "B" if w in "№" else w if w in ",#/-'’" else "x"
    if len(w) > 5 and w[0].isupper() and low.endswith(STREET_ENDS) and (bare == low or low.endswith("str.")):
        return "G"
    if len(bare) == 1:
        return "A"
    return "C" if w[0].isupper() else "w"


def _names(text: str, lexicon: Lexicon, keep, out: list):
    of = lexicon.of
    for m in _NAME.finditer(text):
        a, b = m["a"], m["b"]
        la = "I" if a[-1] == "." else of.get(a.lower(), "u")
        lb = "I" if b[-1] == "." else of.get(b.lower(), "u")
        if la not in "GgFf" and lb not in "GgFf" and not (la in "uI" and lb == "u" and a[0].isupper() and b[0].isupper() and _person_near(text, m.start())):
            continue
        # a common word in small letters is no part of a name, and neither is one of a sentence in any case
        if (la == "c" and not a[0].isupper()) or (lb == "c" and not b[0].isupper()):
            continue
        mid, comma = m["m"], "," in m["s"]
        between = "" if not mid else "m" if mid[-1] == "." else "p"
        order = f"{la}{',' if comma else ''}{between}{lb}"
        ends = [(m.end("b"), order, _case(a) + _case(b))]
        third = _THIRD.match(text, m.end("b")) if b[-1] != "." else None
        if third and not comma:
            c = third[1]
            lc = of.get(c.lower(), "u")
            if lc in "uFfGg" and c[0].isupper() and a[0].isupper():
                ends.append((third.end(1), order + lc, _case(a) + _case(b) + _case(c)))
        for e, full, case in ends:
            key = f"{full}|{case}"
            if e - m.start() <= LONGEST["name"] and keep("name", key):
                line = text[max(0, m.start() - 60) : m.start()]
                cue = _name_cue(line)
                before, after = _words_around(line.rpartition("\n")[2], text[e : e + 24].partition("\n")[0])
                out.append((m.start(), e, "name", key, [f"cue={cue}", f"with={cue}:{full}", f"before={before.lower()}", f"behind={after.lower()}", f"beforecase={_kind_of(before)}", f"behindcase={_kind_of(after)}"]))


def spans(text: str, lexicon: Lexicon, keep=_always) -> list[tuple[int, int, str, str, list[str]]]:
    """(start, end, kind, key, context) of every proposed span for which ``keep(kind, key)`` holds."""
    out: list = []
    hinted = _EMAIL_HINT.search(text) is not None
    if hinted or any(map(str.isdigit, text)):
        at = 0
        for line in text.split("\n"):
            if hinted and _EMAIL_HINT.search(line):
                _emails(line, at, keep, out)
            if any(map(str.isdigit, line)):
                if _SIX_DIGITS.search(line):
                    _numbers(line, at, keep, out)
                _places(line, at, keep, out)
            at += len(line) + 1
    _names(text, lexicon, keep, out)
    out.sort(key=lambda c: (c[1], c[0]))
    return out


# Words that announce a phone number, an identity number, and other numbers, in the languages of the data.
_PHONE_CUES = "tel phone call cell cellphone mobile mob fax reach ring dial text whatsapp telephone hotline telefon телефон тел звоните позвоните моб мобильный дзвоніть ruf anruf anrufen erreichbar nummer handy mobil rufnummer durchwahl appelez appelle llama llamar teléfono téléphone portable móvil celular celular telefone ligue telemóvel chiamare chiamami cellulare telefono zadzwoń komórka tel 电话 手机 ☎ number número numéro numero numer номер"
_ID_CUES = "ssn passport id nid tax national identity social steuer-id steuer steuernummer ausweis ausweisnummer reisepass personalausweis dni nie nif cif passeport sécurité sociale nir паспорт паспорта снилс инн паспортные insurance nino ni identité d'identité pièce identidad licence license документа документ cpf rg cnpj nif bsn codice fiscale pesel dowód dowodu nip aadhaar pan tin tfn sin ahv паспортний рнокпп ідентифікаційний 身份证 护照"
_OTHER_CUES = "order invoice ticket batch serial ref reference sku lot parcel version build release seed mod modulo modulus hash base key sum total checksum isbn port row rows page answer weight prime offset commit revision timestamp date ip host bestellung rechnung заказ счёт сид pedido commande facture ordine zamówienie"
_CUES = {w: kind for kind, words in (("n", _OTHER_CUES), ("p", _PHONE_CUES), ("i", _ID_CUES)) for w in words.split()}


def _cue(line: str, start: int) -> str:
    """The kind of number that the words just before announce, if any; the last one counts.

    A word between the cue and the number that is no cue leaves it as it is.
    """
    found = ""
    for w in _WORDY.findall(line[max(0, start - 60) : start])[-8:]:
        low = w.lower()
        kind = _CUES.get(low)
        # "number" alone says nothing new after "passport", and so do the Polish "nie" and the like in prose
        if kind and not (kind == "p" and found == "i" and low in ("number", "número", "numéro", "numero", "numer", "номер", "nummer")) and not (low in ("nie", "pan", "sin", "ni", "rg", "text") and not w.isupper()):
            found = kind
    return found


# What stands before a person's name, in the languages of the data.
_PERSON_WORDS = "by to from author ask thanks thank von regards grüße saludos cordialement уважением прислал danke an gracias a dank gruß merci à à mr mrs ms dr prof professor herr frau señor señora sr sra monsieur madame mme signor signora pan pani господин госпожа пан colleague friend coach teacher student neighbour neighbor brother sister boss manager author organiser organizer volunteer kollege kollegin freund freundin collègue amie ami amigo amiga colega compañero compañera collega amico amica kolega koleżanka коллега коллеге друг подруга тренер учитель студент автор колега name names named called signed sincerely yours cheers saluti atenciosamente abraços pozdrawiam obrigado obrigada grazie dziękuję dzięki спасибо дякую привет hi hello dear hallo bonjour hola olá ciao cześć witam met contact attn attention nom nombre nome imię имя name:"
_PERSONS = set(_PERSON_WORDS.split())


def _person_near(text: str, start: int) -> bool:
    return _name_cue(text[max(0, start - 40) : start]) != ""


def _name_cue(line: str) -> str:
    """What before a name says that a person follows: the line's start (perhaps under a salutation), a mark, or a word
    among the last three."""
    own = line.rpartition("\n")[2]
    bare = own.rstrip(" \t")
    if not bare:
        above = _WORDY.findall(line[: -len(own) or None].rstrip()[-24:])
        return "signed" if above and above[-1].lower() in _PERSONS else "line"
    if bare[-1] in "|;<\"":
        return bare[-1]
    words = _WORDY.findall(bare)[-3:]
    near = [w.lower() in _PERSONS for w in words]
    if near and near[-1]:
        return "word" + ("" if bare[-1].isalpha() else bare[-1])
    return "near" if any(near) and bare[-1].isalpha() else ""


def _case(word: str) -> str:
    bare = word.rstrip(".")
    return "U" if bare.isupper() and len(bare) > 1 else "T" if bare[:1].isupper() else "l"


def _kind_of(token: str) -> str:
    return token if token in "^$" or not token[0].isalnum() else "9" if token[0].isdigit() else "w" if token.islower() else "T"


def _words_around(line: str, rest: str) -> tuple[str, str]:
    before, after = _TOKEN.findall(line[-24:]), _TOKEN.findall(rest)
    return (before[-1] if before else "^", after[0] if after else "$")


def _sides(line: str, s: int, e: int) -> list[str]:
    before, after = _words_around(line[:s] if s < 24 else line[s - 24 : s], line[e : e + 24])
    return [f"before={before.lower()}", f"behind={after.lower()}", f"sides={_kind_of(before)}{_kind_of(after)}"]


# ---------------------------------------------------------------- finding


class Model:
    """Fitted weights with their lexicon; finds and replaces."""

    def __init__(self, weights: dict[str, float], steps: np.ndarray, lexicon: Lexicon):
        """``steps`` are transition scores (kind before, or none, in the last row; kind)."""
        self.weights, self.steps, self.lexicon = weights, steps.tolist(), lexicon
        self.slack = 3 * float(np.abs(steps).max(initial=0.0))
        most: dict = defaultdict(lambda: defaultdict(float))
        for f, w in weights.items():
            kind, _, rest = f.partition("~")
            if rest:
                slot = rest.partition("=")[0]
                most[kind][slot] = max(most[kind][slot], w)
        self.most = {k: sum(most[k].values()) for k in KINDS}
        self.scores: dict = {}

    def key_score(self, kind: str, key: str) -> float:
        found = self.scores.get((kind, key))
        if found is None:
            if len(self.scores) > 200_000:
                self.scores.clear()
            get = self.weights.get
            found = self.scores[kind, key] = get(f"{kind}|bias", 0.0) + sum(get(f"{kind}|{f}", 0.0) for f in _FEATURES[kind](key))
        return found

    def _keep(self, kind: str, key: str) -> bool:
        """Whether a span with this key can still be in a best cut: what its context and its neighbours can add is bounded."""
        return self.key_score(kind, key) + self.most[kind] + self.slack >= 0

    def find(self, text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        get, scored = self.weights.get, []
        for s, e, kind, key, context in spans(text, self.lexicon, self._keep):
            w = self.key_score(kind, key) + sum(get(f"{kind}~{f}", 0.0) for f in context)
            if w + self.slack >= 0:
                scored.append((s, e, kind, w))
        return best_cut(scored, self.steps)

    def replace(self, text: str | None) -> str | None:
        """The text with ``[EMAIL]``-like placeholders; everything else stays as it is."""
        if not text:
            return text
        out, at = [], 0
        for s, e, kind in self.find(text):
            out += [text[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join([*out, text[at:]])

    def __getstate__(self):
        return {**self.__dict__, "scores": {}}


def best_cut(scored, steps) -> list[tuple[int, int, str]]:
    """The best set of spans (start, end, kind, score) that do not overlap, with transition scores between neighbours.

    ``scored`` is ordered by end.  For every end the best score by the kind of the last segment is kept.
    """
    none = len(KINDS)
    ends, best = [0], [[(-np.inf, None)] * none + [(0.0, None)]]
    for s, e, kind, w in scored:
        k = _NUMBER_OF[kind]
        before = best[bisect_right(ends, s) - 1]
        total, back = max(((v + steps[j][k] + w, (s, e, kind, link)) for j, (v, link) in enumerate(before) if v > -np.inf), key=lambda x: x[0])
        if total > best[-1][k][0]:
            row = list(best[-1])
            row[k] = (total, back)
            if ends[-1] == e:
                best[-1] = row
            else:
                ends.append(e)
                best.append(row)
    out, link = [], max(best[-1], key=lambda x: x[0])[1]
    while link:
        out.append(link[:3])
        link = link[3]
    return out[::-1]


# ---------------------------------------------------------------- fitting


class _Lattice:
    """Texts of one batch, padded to the same number of spans, for sums over all cuts of all texts at once."""

    def __init__(self, texts, index):
        wide = max(len(t) for t in texts)
        n = len(texts)
        self.kind = np.zeros((n, wide), np.int64)
        self.before = np.zeros((n, wide), np.int64)
        self.there = np.zeros((n, wide), bool)
        self.gold = np.zeros((n, wide))
        self.gold_steps = np.zeros((len(KINDS) + 1, len(KINDS)))
        rows, features = [], []
        for i, t in enumerate(texts):
            ends = [c[1] for c in t]
            last = len(KINDS)
            for j, (s, _, kind, names, right) in enumerate(t):
                self.kind[i, j], self.before[i, j], self.there[i, j], self.gold[i, j] = _NUMBER_OF[kind], bisect_right(ends, s), True, right
                if right:
                    self.gold_steps[last, _NUMBER_OF[kind]] += 1
                    last = _NUMBER_OF[kind]
                rows += [i * wide + j] * len(names)
                features += [index[f] for f in names]
        self.rows, self.features = np.array(rows), np.array(features)

    def gradient(self, weights, steps):
        """Loss (negative log-likelihood), and its gradients by weight and by step."""
        n, wide = self.kind.shape
        none, at = len(KINDS), np.arange(n)
        scores = np.bincount(self.rows, weights[self.features], n * wide).reshape(n, wide)
        scores = np.where(self.there, scores, -1e9)
        # forward[i, c, k]: log-sum over the cuts among the first c spans whose last segment is of kind k
        forward, alpha = np.full((n, wide + 1, none + 1), -1e9), np.empty((n, wide))
        forward[:, 0, none] = 0.0
        for c in range(wide):
            k = self.kind[:, c]
            into = forward[at, self.before[:, c]] + steps[:, k].T
            top = into.max(1)
            alpha[:, c] = scores[:, c] + top + np.log(np.exp(into - top[:, None]).sum(1))
            forward[:, c + 1] = forward[:, c]
            forward[at, c + 1, k] = np.logaddexp(forward[at, c, k], alpha[:, c])
        top = forward[:, wide].max(1)
        whole = top + np.log(np.exp(forward[:, wide] - top[:, None]).sum(1))
        back = np.zeros_like(forward)
        back[:, wide] = np.exp(forward[:, wide] - whole[:, None])
        share, step_share = np.zeros((n, wide)), np.zeros_like(steps)
        for c in range(wide - 1, -1, -1):
            k, p = self.kind[:, c], self.before[:, c]
            mine = back[at, c + 1, k] * np.exp(alpha[:, c] - forward[at, c + 1, k])
            keep = back[:, c + 1].copy()
            keep[at, k] *= np.exp(forward[at, c, k] - forward[at, c + 1, k])
            back[:, c] += keep
            share[:, c] = mine
            flow = mine[:, None] * np.exp(forward[at, p] + steps[:, k].T + (scores[:, c] - alpha[:, c])[:, None])
            np.add.at(back, (at[:, None], p[:, None], np.arange(none + 1)[None]), flow)
            np.add.at(step_share, (np.arange(none + 1)[None].repeat(n, 0), k[:, None].repeat(none + 1, 1)), flow)
        loss = whole.sum() - (scores * self.gold).sum() - (steps * self.gold_steps).sum()
        by_weight = np.bincount(self.features, (share - self.gold).ravel()[self.rows], len(weights))
        return loss, by_weight, step_share - self.gold_steps


def fit(labelled, lexicon: Lexicon, epochs: int = 12, batch: int = 384, rate: float = 0.08, decay: float = 2e-3, seed: int = 1, widest: int = 160) -> tuple[dict, np.ndarray]:
    """Weights and transition scores of greatest penalised likelihood, from (text, [(start, end, kind)]), by Adam steps.

    A text with more than ``widest`` spans is left out of fitting (the generated ones hardly reach it).
    """
    prepared = []
    for text, gold in labelled:
        want = set(gold)
        mine = [(s, e, kind, [f"{kind}|bias", *(f"{kind}|{f}" for f in _FEATURES[kind](key)), *(f"{kind}~{f}" for f in context)], (s, e, kind) in want) for s, e, kind, key, context in spans(text, lexicon)]
        if mine and len(mine) <= widest:
            prepared.append(mine)
    index: dict[str, int] = {}
    for t in prepared:
        for c in t:
            for f in c[3]:
                index.setdefault(f, len(index))
    prepared.sort(key=len)
    lattices = [_Lattice(prepared[i : i + batch], index) for i in range(0, len(prepared), batch)]
    weights, steps = np.zeros(len(index)), np.zeros((len(KINDS) + 1, len(KINDS)))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, steps)]
    rng, done, total = np.random.default_rng(seed), 0, epochs * max(1, len(lattices))
    for _ in range(epochs):
        for at in rng.permutation(len(lattices)):
            done += 1
            _, by_weight, by_step = lattices[at].gradient(weights, steps)
            size = rate * (1 - 0.9 * done / total)
            for x, g, (mean, square) in zip((weights, steps), (by_weight, by_step), state):
                g = g + decay * len(lattices[at].kind) * 0.05 * x
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                x -= size * (mean / (1 - 0.9**done)) / (np.sqrt(square / (1 - 0.99**done)) + 1e-8)
    return {f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-4}, steps


def train(texts, given, family) -> Model:
    """A model from the listed names and texts (for the lexicon only)."""
    return train_with(learn_lexicon(texts, given, family))


def train_with(lexicon: Lexicon) -> Model:
    from verdigris.llm.personal_grammar import training_texts

    return Model(*fit(training_texts(lexicon), lexicon), lexicon)
