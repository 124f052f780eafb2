"""Labelled texts to fit the model of :mod:`verdigris.llm.personal` on.

A grammar makes them: items by formats of countries, sentences that carry an item put together from an opening and a
close of one language, and lines that only look like items.  It is written from general knowledge of such formats;
none of its sentences is taken from a table, and no document is read.
"""

from __future__ import annotations

import random
import re

from verdigris.llm.personal import _OTHER_CUES, KINDS, STREET_WORDS, Lexicon

# National significant numbers by country code; 9 is any digit and _ a place where groups part.
PHONE_PLANS = {
    "1": "999_999_9999", "44": "9999_999_999 9999_999999 99_9999_9999 999_999_9999", "49": "99_99999_999 99_99999999 999_9999999 9999_999999", "33": "9_99_99_99_99", "34": "999_999_999 99_999_99_99 999999999", "39": "99_9999_9999 999_999_9999",
    "7": "999_999_99_99 999_999_9999", "380": "99_999_99_99 99_9999999", "48": "999_999_999 99_999_99_99", "351": "999_999_999", "55": "99_99999_9999 99_9999_9999", "86": "999_9999_9999 99_9999_9999", "91": "99999_99999 9999_999_999", "61": "9_9999_9999 499_999_999",
    "31": "9_99999999 99_999_9999", "41": "99_999_99_99", "43": "9_999_9999 999_999999", "46": "99_999_99_99", "90": "999_999_99_99", "81": "99_9999_9999",
}
#: Numbers as they are dialled at home, with the trunk digit; ~ is one separator used throughout.
PHONE_HOME = "09999~999999 099~9999~9999 09999~999~999 0999~999~9999 999~999~9999 (999)~999-9999 (099)~99999~999 099/99999-999 09~99~99~99~99 0999~999999 999~99~99~99 999-99-99 999-9999 999.9999 8~999~999~99~99 8-999-999-9999 8 (999) 999-99-99 0499~999~999 09~9999~9999 (99) 99999-9999 099-999-999 9999~9999 9999999999 09999999999 0999~999~99~99 999999999".split()
# Identity numbers of many countries; A is a capital.
IDENTITY_FORMATS = (
    "AA999999A|AA 99 99 99 A|AA9999999|999999999|999 99 9999|999-99-9999|A99-999999|A99999999|9999 № 999999|9999 999999|99 99 999999|99999999999|99 999 999 999|999999999999999|9 99 99 99 999 999 99|999999999999"
    "|A9A999999A|A-9999999-A|A9999999A|99.999.999-A|99999999A|99999999-A|999-999-999 99|99AA99999|AAA999999|AAA 999999|999.999.999-99|99.999.999-9|AAAAA9999A|9999 9999 9999|999999-9999|756.9999.9999.99|AAAAAA99A99A999A|99999999999999999A|999 999 999|99999999|AA 999999|AA999999"
).split("|")

# What may stand before and behind an item, by kind and language; the two are drawn apart.
OPENINGS = {
    "phone": {
        "en": ["My number is now ", "Ring me on ", "Phone: ", "Mobile ", "Tel ", "fax ", "dial ", "For urgent things text ", "Call ", "call me: ", "cell ", "cell: ", "reach us under ", "the office number is ", "WhatsApp ", "☎ ", "Contact tel. ", "You get me at ", "the desk answers on number ", "reach me at "],
        "de": ["Meine neue Nummer: ", "Ruf mich an: ", "Telefon ", "Tel. ", "Handy ", "Du erreichst mich unter ", "Mobil: ", "Erreichbar: ", "Durchwahl "],
        "fr": ["Appelle-moi au ", "Tél. : ", "Mon portable : ", "Téléphone ", "Mon numéro est le ", "joignable au "],
        "es": ["Llámame al ", "Tel.: ", "Mi móvil es ", "Teléfono: ", "Mi número: "], "pt": ["Ligue para ", "Telefone: ", "Meu celular é ", "telemóvel "], "it": ["Chiamami al ", "Cellulare: ", "Tel. ", "Il mio numero è "],
        "pl": ["Zadzwoń: ", "Mój telefon to ", "tel. ", "Komórka "], "ru": ["Звоните по номеру ", "Тел. ", "Мой мобильный ", "Телефон: ", "тел. "], "uk": ["Дзвоніть: ", "Мій телефон ", "тел. "], "zh": ["电话：", "手机 "],
    },
    "identity": {
        "en": ["My social security number is ", "SSN: ", "SSN ", "passport number ", "Passport no. ", "tax id ", "National id: ", "driving licence ", "NI number ", "nid=", "ID card no ", "my identity number reads ", "national number, it says ", "the national number is ", "CPF ", "PESEL ", "BSN: "],
        "de": ["Steuer-ID: ", "Meine Steuernummer lautet ", "Reisepass ", "Personalausweis Nr. ", "Ausweisnummer "], "fr": ["N° de sécurité sociale : ", "passeport n° ", "passeport nº ", "Carte d'identité ", "pièce d'identité "],
        "es": ["DNI: ", "Su DNI es ", "NIE ", "Mi NIE: ", "pasaporte ", "NIF "], "pt": ["CPF ", "Meu CPF é ", "NIF: ", "RG "], "it": ["Codice fiscale: ", "carta d'identità "], "pl": ["PESEL: ", "dowód osobisty ", "Numer PESEL to "],
        "ru": ["паспорт ", "Паспорт РФ ", "СНИЛС: ", "СНИЛС ", "ИНН ", "Номер паспорта "], "uk": ["паспорт ", "РНОКПП "], "zh": ["身份证 ", "护照 "],
    },
    "email": {
        "en": ["Mail me: ", "e-mail ", "Send it to ", "cc ", "contact <", "drop a line to ", "Please use ", "address: ", "To: ", "answers to ", "my mail is ", "write to ", "(", "mail="], "de": ["Mail an ", "Schreib mir: ", "E-Mail: "], "fr": ["Écris-moi : ", "courriel ", "mél. "], "es": ["Correo: ", "mándalo a ", "mi dirección es "],
        "pt": ["E-mail: ", "envie para "], "it": ["Scrivimi a ", "posta: "], "pl": ["Napisz na ", "mejl: "], "ru": ["Пишите: ", "почта ", "мой адрес "], "uk": ["Пишіть на ", "пошта: "], "zh": ["邮箱："],
    },
    "address": {
        "en": ["We moved to ", "Deliver to ", "Address: ", "My flat is at ", "Come to ", "the parcel went to ", "I stay at ", "The venue is ", "post to ", "she lives at ", "held at ", "pick it up from "], "de": ["Adresse: ", "Ich wohne ", "Lieferung an ", "Treffpunkt ", "Wir sitzen in der "], "fr": ["J'habite ", "Livrez au ", "Adresse : ", "on se voit au ", "le paquet va au "],
        "es": ["Vivo en ", "Dirección: ", "Mándalo a "], "pt": ["Moro na ", "Endereço: "], "it": ["Abito in ", "Indirizzo: "], "pl": ["Mieszkam przy ", "Adres: "], "ru": ["Адрес: ", "Я живу на ", "доставка: "], "uk": ["Адреса: ", "Мешкаю "],
    },
    "name": {
        "en": ["Many thanks to ", "found by ", "Dear ", "my colleague ", "Ask ", "sent by ", "Contact ", "Best, ", "Yours, ", "Cheers, ", "Regards, ", "signed ", "Dr. ", "Prof. ", "my coach ", "Author: ", "hello, ", "we met ", "according to "], "de": ["Danke an ", "Herr ", "Frau ", "gefunden von ", "Gruß, ", "mein Kollege "], "fr": ["Merci à ", "Madame ", "signé ", "mon ami ", "Bien à vous, "],
        "es": ["Gracias a ", "Señor ", "Un saludo, ", "mi amigo "], "pt": ["Obrigado a ", "Abraços, ", "a colega "], "it": ["Grazie a ", "Signora ", "Saluti, "], "pl": ["Dziękuję, ", "Pan ", "Pozdrawiam, "], "ru": ["Спасибо, ", "Автор: ", "тренер ", "коллега "], "uk": ["Дякую, ", "Автор: "],
    },
}
CLOSES = {
    "en": ["", "", ".", ".", "!", ", please", ", second floor", ", not before ten", ", ask for the caretaker", " until Friday", " if anything breaks", " (evenings)", "; thanks", ", was refused", ", is that enough?", "; it rings in the hall", " found the gap", " sent the patch", " in the evening", ">", ")"],
    "de": ["", "", ".", ", bitte", ", abends", " bis Montag", ", danke", " am Tor", " im Hof", " an der Ecke"], "fr": ["", "", ".", ", merci", ", le matin", " mardi"], "es": ["", "", ".", ", gracias", ", por la noche"], "pt": ["", ".", ", obrigado", " à noite"], "it": ["", ".", ", grazie", " di sera"], "pl": ["", ".", ", proszę", " wieczorem"],
    "ru": ["", "", ".", ", пожалуйста", ", вечером", ", спасибо"], "uk": ["", ".", ", дякую", " увечері"], "zh": ["", "。"],
}
#: Lines of several items; names in braces are kinds, # is a number.
LAYOUTS = [
    "#;{name};{address};{phone};{email}", "#;{name};{address};{email};{phone}", "#;{name};{email};{address};{phone}", "#;{name};{address};{identity};{email}", "{name},{email},{phone}", "| {name} | {identity} | done |", "| {name} | {identity} | - |", "| {name} | {identity} | late |", '{"id": #, "email": "{email}", "phone": "{phone}"}', '{"contact": "{email}", "tel.": "{phone}"}', '{"e": "{email}", "tel":"{phone}", "n": #}', '{"name": "{name}", "nid": "{identity}"}',
    "email={email}&nid={identity}", "mail={email}&nid={identity}", "user={email}&ssn={identity}&x=#", "mail={email}&tel={phone}", "user={email}&page=#", "{name} <{email}>", "From: {name} <{email}>", "# made by {name} <{email}>", "// {name} ({email})", "@author {name}, {email}", "Reviewed-by: {name} <{email}>", '"""{name}, {email}"""', "{name}\n{address}\n{phone}", "{name}\n{address}\n{phone}\n", "--\n{name}\n{address}\n{phone}", "kind regards\n{name}\n{address}\n{phone}", "Best,\n{name}", "--\n{name}\n{phone}", "kind regards\n{name}\n{email}",
    "{name}\n{address}", "{phone} / {email}", "{name}", "{address}", "{phone}", "{email}", "> {name} {phone}", "> {name} {email}", "passport / {identity} / expires soon", "card / {identity} / new", "Tel {phone}, Fax {phone}",
]

# Words of the lines that hold no item.
_VERBS = {
    "en": "keeps wants needs draws counts says thinks builds moves waits paints".split(), "de": "hat will braucht zählt baut sagt".split(), "fr": "range veut compte garde pense".split(), "es": "guarda quiere cuenta necesita".split(), "it": "tiene vuole conta".split(), "pt": "guarda quer conta".split(),
    "ru": "хранит хочет считает строит".split(), "uk": "зберігає хоче рахує".split(), "pl": "trzyma chce liczy".split(),
}
_NOUNS = {"en": "beads tiles lamps boxes marbles towers plates".split(), "de": "Perlen Kisten Türme Lampen".split(), "fr": "perles boîtes tours".split(), "es": "cajas torres perlas".split(), "it": "scatole torri".split(), "pt": "caixas torres".split(), "ru": "бусин башен коробок".split(), "uk": "коробок веж".split(), "pl": "pudełek wież".split()}
_WITH_ONE = ["Help {given} with {n} {noun}.", "Let {given} {verb} them", "{given} and {given} play in turns.", "{given}, {given} and {given} share {n} {noun}", "Can {given} win after {n} moves?", "so {given} {verb} {n}", "{given} {verb} {n} {noun}", "{given} {verb} {n} {noun}.", "what {given} {verb}: {n}", "The least cost that {given} needs", "Find how much {given} pays", "Hi {given}, see page {n}", "hello {given}", "Ask {given} for {n} {noun}.", "Thanks {given}!"]
_TITLES = "Amber Silver Quiet Broken Northern Hollow Golden Clever Little Stone Winter Copper Blue".split()
_THINGS = "Foxes Lanterns Bridge Kettle Harbour Garden Road Hill Square Court Park Tower Owls Falcons Ladder Trees Lane Way Street Row".split()
_OTHER_NUMBERS = [
    "{cue} is {g8}", "{cue} is {g7}", "the {cue} {g9}", "{cue}: {g8}", "{cue} {g10}", "order {g4}-{g3}-{g4}", "order no. {g4}-{g3}-{g4}, {g2}-{g2}-{g2} kg", "invoice {g9}", "parcel {g3} {g3} {g3}", "serial {g4}-{g4}-{g4}", "weight {g2}-{g2}-{g2}", "order {g4}-{n}-{g4}", "{cue} {g3}-{n}-{g4}", "ticket AB-{g4}-{g2}", "sku {g3}-{g4}", "ref {g10}", "MOD = {big}", "modulo {big}", "mod {big},", "take everything modulo {big}.", "по модулю {big}", "módulo {big}", "modulo {big} ausgeben", "the residue by {big}", "hash = {g10}", "h = {g9}", "seed {g9}", "seed: {g10}", "seeds {g9} and {g9}",
    "the key {g10} is random", "checksum {g9}", "ans = {g11}", "% {big}", "({v} * {g6} + {g5}) % {big}", "base {g6}, modulus {big}", "x = x * {g10} + {g9}", "{v}[{n}] = {g9}", "return {v} % {big}", "{date}", "since {date} {time}", "built {date} {time}, job {g4}", "[{time}] {v}: fine", "at {time} on {date}", "host 10.{n}.{n}.{n}", "ping 192.168.{n}.{n}", "release {n}.{n}.{n}", "v{n}.{n}.{n}-rc{n}", "pages {n}-{n}", "{n} {n} {n} {n} {n}", "{n} {n} {n} {n} {n} {n} {n} {n}", "{row}", "{row}", "{row}", "Input\n{row}\nOutput\n{n}", "{n}\n{row}\n{n}", "Input {n}\n{n} {n}\n{row}", "{row}\n{row}", "{n} {n} {n}", "{big} {big}",
    "{n} {n}\n{n} {n} {n} {n}\n{n} {n} {n}", "{g6} {g6}", "{g3} {g3} {g3} {g3}", "{g2} {g2} {g2} {g2} {g2}", "0 {n} 0 {n} {n} 0", "1 {g5} {g5}", "-{n} {n} -{n}", "[{n}, {n}, {n}, {n}]", "{n}, {n}, {n}, {n}", "{n}.{g6}", "{n}.{g9}", "{g3}.{g6} {g2}.{g6}", "1e9+7 or {big}", "{g6}..{g6}", "{n} <= {v} <= {g6}", "1 ≤ {v}, {v} ≤ {g6}", "{g16} is a prime", "{g19}", "{g10} {g10}", "{g7}, {g7}", "total {g7}", "score: {g6} of {g6}", "commit {g7}", "row {g6}: ok",
    "for {v} in range({g3}, {g6}):", "print({v}[{n}], {n} - {n})", "while {v} > {g6}:", "{v} = {g7} - {v} * {g6}", "{v} += {g7}", "if ({v} - {g6}) % {g3} == 0:", "timestamp {g10}", "isbn {g3}-{n}-{g4}-{g4}-{n}", "{v}{g6} = {g6}", "0x{g8}", "range(1{g6})",
]
_LOOKALIKES = [
    "`{v} @ {v}.T`", "{v}@{v}.shape", "{v} @ {v}.{v} is a product", "@{v}_{v}(size={n})", "@{v}", "decorate it with `@{v}.{v}`", "re.compile('\\\\S+@\\\\S+')", "meet at {time} at the gate", "look at {v}.{v} first", "{v}.{v}({v})", "at dot zero", "Team {title} {thing} got {n} points", "team {title} {thing}, place {n}", "the {title} {thing} riddle, {n} tests", "{title} {thing} ({n})", "# {title} {thing}", "Level {n} {title} {thing}", "chapter {n} {title} {thing}, page {n}", "section {n} {title} {thing}",
    "> Team {title} {thing} is {n}th", "{n} ways to cross the {title} {thing}", "{n} {noun} by the {title} {thing}", "a square of {n} tiles", "way {n} is blocked", "{n} steps along the road", "row {n}, place {n}", "In {place} stand {n} {noun}", "In the town of {place} we count {n} roads", "the {place} trick, about {n} lines", "The {place} Open round {n}", "the train to {place} takes {n} minutes", "im Dorf {place} stehen {n} Häuser, von Straßen umgeben", "la ville de {place} a {n} places", "en la plaza de {place} hay {n} torres",
    "на площади {place} {n} домов", "The {family} method in {n} steps", "a {family} sieve with {n} rounds", "apply the {family} bound in {place}", "Test {n} in {place}", "Subject: Re: test {n}", "diff a{n}..b{n}", "Alpha Beta {n}", "New Year Round {n}", "Hello World", "Wenn der {thing} steht", "Da der {place} fehlt, {n}", "Quand le {place} dort", "Cuando el {place} para", "Se il {place} cade", "Bis der {title} kommt", "Wo die {thing} von {place} ist", "Limit {n} seconds", "Input {n}", "WA, case {n}", "Good Luck {given}", "King {given} of {place}", "{place} {place} {n}", "{given} {place} {n}",
]

_HOLE = re.compile(r"\{(name|email|address|phone|identity)\}|#")
_PLAIN_HOLE = re.compile(r"\{(\w+)\}")


class _Maker:
    """Items and lines drawn from one seed."""

    def __init__(self, lexicon: Lexicon, seed: int):
        self.rng = random.Random(seed)
        self.given = sorted(w for w, k in lexicon.of.items() if k in "Gg") or ["anna", "boris"]
        self.family = sorted(w for w, k in lexicon.of.items() if k in "Ff") or ["smith", "jones"]

    def digits(self, form: str) -> str:
        return "".join(str(self.rng.randint(0, 9)) if c == "9" else self.rng.choice("ABCDEFGHKLMNPQRXYZ") if c == "A" else c for c in form)

    def word(self) -> str:
        pick = self.rng.choice
        return pick("br cl d f g h k l m n p r s t v w z tr st sh".split()) + pick("aeiou") + pick("l n r s t m rn ld st ck".split()) + pick(["", "", "a", "o", "en", "er"])

    def place(self) -> str:
        return (self.word() + self.rng.choice("dale fort holm lin mond stead reth tov wick by gard mere burg".split())).capitalize()

    def title(self, w: str) -> str:
        return "-".join("'".join(p[:1].upper() + p[1:] for p in x.split("'")) for x in w.split("-"))

    def phone(self) -> str:
        pick, roll = self.rng.choice, self.rng.random()
        if roll < 0.12:
            plan = pick([p for own in PHONE_PLANS.values() for p in own.split() if p[1] != "_"])
            out = self.digits(plan.replace("_", pick([" ", " ", "-"])))
        elif roll < 0.55:
            out = self.digits(pick(PHONE_HOME).replace("~", pick([" ", " ", "-", ".", ""])))
        else:
            code = pick(list(PHONE_PLANS))
            own, gap = pick(PHONE_PLANS[code].split()), pick([" ", " ", " ", "-", ".", ""])
            head = pick([f"+{code}{gap or ' '}", f"+{code}{gap or ' '}", f"+{code}{pick([gap, ''])}", f"(+{code}) ", f"00{code}{gap or ' '}", f"+{code}(0)", f"+{code} (0)"])
            if "_" in own and self.rng.random() < 0.25:
                area, _, rest = own.partition("_")
                own = f"({area}) {rest}"
                head = pick([f"+{code} ", f"{code} ", f"+{code}"])
            elif self.rng.random() < 0.08:
                head = f"{code}{gap or ' '}"
            out = self.digits(head.replace("9", "\0") + own.replace("_", gap)).replace("\0", "9")
        if self.rng.random() < 0.12:
            out += pick([" ext. ", " ext ", " x", " доб. ", " ext."]) + self.digits(pick(["99", "999", "9999"]))
        return out

    def identity(self) -> str:
        return self.digits(self.rng.choice(IDENTITY_FORMATS))

    def name(self) -> str:
        pick = self.rng.choice
        g, f = self.title(pick(self.given)), self.title(pick(self.family))
        if self.rng.random() < 0.12:
            f = self.title(self.word() + self.word())  # a family name that no list has
        if self.rng.random() < 0.06:
            g = self.title(self.word() + self.word())
        if self.rng.random() < 0.06:
            f = f"{pick(['van', 'de', 'von', 'van der', 'di', 'al'])} {f}"
        out = pick([f"{g} {f}"] * 6 + [f"{g} {pick('ABCDHKLM')}. {f}", f"{g[0]}. {f}", f"{f}, {g}", f"{f}, {g}", f"{f} {g}", f"{g} {f} {self.title(self.word() + 'ez')}" if self.rng.random() < 0.2 else f"{g} {f}"])
        return pick([out] * 7 + [out.upper(), out.lower()])

    def stranger(self) -> str:
        """A name of which no part is known; only its surroundings show it."""
        between = self.rng.choice([" ", " ", " ", " ", " van ", " de ", " von ", " K. "])
        return f"{self.title(self.word() + self.word())}{between}{self.title(self.word() + self.word())}"

    def email(self) -> str:
        pick = self.rng.choice
        g, f = pick(self.given), re.sub(r"\W", "", pick(self.family))
        local = pick([f"{g}.{f}", f"{g}_{f}", f"{g[0]}{f}", f"{f}{self.rng.randint(10, 99)}", f"{g}-{self.rng.randint(100, 999)}", f"{f}+{self.word()}", self.word(), self.word(), f"{self.word()}s", f"{self.word()}.{self.word()}{self.rng.randint(1, 99)}"])
        labels = [pick([self.word(), f"{self.word()}-{self.word()}", f"{self.word()}.{self.word()}", "mail", f"x{self.rng.randint(1, 9)}.{self.word()}"]), pick("example test org com net invalid io de fr ru pl edu co".split())]
        domain = ".".join(labels)
        style = self.rng.random()
        if style < 0.14:
            out = f"{local}{pick([' [at] ', ' (at) ', '[at]', ' {at} '])}{domain.replace('.', pick([' [dot] ', ' (dot) ', '[dot]']))}"
        elif style < 0.24:
            out = f"{local}{pick([' (at) ', ' [at] ', '(at)', ' (собака) '])}{domain}"
        elif style < 0.27:
            out = f"{local} at {domain.replace('.', ' dot ')}"
        else:
            out = f"{local}{pick(['@'] * 7 + [' @ ', '＠'])}{domain}"
        return out.upper() if self.rng.random() < 0.15 and style >= 0.27 else out

    def address(self) -> str:
        pick, n = self.rng.choice, self.rng.randint(1, 399)
        street, form = self.place(), self.rng.random()
        if self.rng.random() < 0.2:
            street += " " + self.title(self.word())
        if form < 0.5:
            out = f"{n}{pick(['', '', '', 'b', 'A'])} {pick(['', '', '', 'N. ', 'West ', 'S '])}{street} {pick(STREET_WORDS.split()[:-3])}"
            out += "." if out.endswith(" St") else ""
            before, behind = pick(["", "", "", f"Flat {n % 40 + 1}, ", f"Unit {n % 30 + 1}, ", f"{n % 30 + 1}/"]), pick(["", "", "", f", Flat {n % 40 + 1}", f", Apt {n % 9 + 1}{pick('ABC')}", f" #{n % 99 + 1}", f" Apt. {n % 50 + 1}", f", Suite {n}"])
            return before + out if before else out + behind
        if form < 0.63:
            street = street.split()[0]
            return pick([f"{street}{pick(['straße', 'weg', 'gasse', 'platz', 'allee', 'str.', 'straat', 'laan', 'gatan'])} {n}", f"{street}er Straße {n}", f"{pick(['Am', 'An der', 'Im', 'Auf der', 'Zum'])} {street} {n}", f"{pick(['Am', 'Zum'])} {street}berg {n}"]) + pick(["", "", "a", " b", ", Hinterhaus", ", 3. OG", ", Whg. 4"])
        if form < 0.73:
            return f"{n}{pick(['', ' bis', ' ter'])}{pick(['', ','])} {pick(['rue', 'avenue', 'boulevard', 'place', 'chemin', 'quai', 'av.'])} {pick(['', 'de ', 'du ', 'des ', 'de la '])}{street}{pick(['', '', ', appt 4', ', bât. 2'])}"
        if form < 0.82:
            return f"{pick(['Calle', 'C/', 'Avda. de', 'Avda.', 'Plaza', 'Paseo de', 'Calle de la'])} {street}{pick([',', ' n.º', '', ', nº', ','])} {n}{pick(['', ', 2º B', ', bajo', ', 3.º A', ', piso 2'])}"
        if form < 0.87:
            return f"{pick(['Via', 'via', 'Piazza', 'Viale', 'Corso', 'Rua', 'Rua das', 'Rua do', 'Avenida', 'Travessa', 'Praça'])} {street}{pick([' ', ', ', ', n. '])}{n}{pick(['', '', '/A', ', int. 3'])}"
        if form < 0.91:
            return f"{pick(['ul. ', 'ulica ', 'al. ', 'os. ', 'pl. '])}{street} {n}{pick(['', f'/{n % 40 + 1}', ' m. 4', 'a'])}"
        stem = self.title("".join(pick("ба во го ди ле ма но пе ро се ту ча ше".split()) for _ in range(3))) + pick(["вая", "ная", "ская", "ского", "ный"])
        return f"{pick(['ул. ', 'улица ', 'проспект ', 'пр. ', 'пер. ', 'вул. ', 'бульвар '])}{stem}{pick(['', ' ' + stem[:5].capitalize()])}, {pick(['', 'д. ', 'дом ', 'буд. '])}{n}{pick(['', f', кв. {n % 90 + 1}', f', корп. {n % 5 + 1}', f', оф. {n % 60 + 1}'])}"

    def plain(self) -> str:
        pick = self.rng.choice
        language = pick(list(_VERBS) + ["en"] * 6)
        line = pick(pick([_WITH_ONE, _OTHER_NUMBERS, _OTHER_NUMBERS, _LOOKALIKES]))

        def fill(m):
            k = m[1]
            if k[0] == "g" and k[1:].isdigit():
                return str(self.rng.randint(1, 9)) + self.digits("9" * (int(k[1:]) - 1))
            rng = self.rng
            return {
                "n": lambda: str(pick([rng.randint(0, 99), rng.randint(100, 999), rng.randint(1000, 9999), 10 ** rng.randint(2, 6)])), "big": lambda: pick(["1000000007", "998244353", "1000000009", str(rng.randint(10**8, 10**10))]), "given": lambda: self.title(pick(self.given)), "family": lambda: self.title(pick(self.family)), "place": self.place,
                "v": lambda: pick([pick("abcdefghijkmnpqrstuvxyz"), self.word(), f"{self.word()}_{self.word()}"]), "verb": lambda: pick(_VERBS[language]), "noun": lambda: pick(_NOUNS[language]), "title": lambda: pick(_TITLES), "thing": lambda: pick(_THINGS),
                "cue": lambda: pick(_OTHER_CUES.split()), "row": lambda: " ".join(str(rng.randint(0, pick([9, 99, 99, 999]))) for _ in range(rng.randint(2, 12))), "date": lambda: f"{rng.randint(2001, 2029)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}" if rng.random() < 0.7 else f"{rng.randint(1, 28):02}.{rng.randint(1, 12):02}.{rng.randint(2001, 2029)}", "time": lambda: f"{rng.randint(0, 23):02}:{rng.randint(0, 59):02}" + pick(["", f":{rng.randint(0, 59):02}"]),
            }[k]()

        line = _PLAIN_HOLE.sub(fill, line)
        if self.rng.random() < 0.3:
            line = f"{self.prose()} {line}"
        return line.upper() if self.rng.random() < 0.12 else line

    def prose(self) -> str:
        """Made-up words: what stands around an item may be anything."""
        words = [self.word() for _ in range(self.rng.randint(1, 4))]
        if self.rng.random() < 0.2:
            words[-1] = words[-1].capitalize()
        return " ".join(words)

    def carried(self) -> tuple[str, list[tuple[int, int, str]]]:
        """A line with items, and where they are."""
        pick, text, gold = self.rng.choice, "", []
        if self.rng.random() < 0.3:
            layout, at = pick(LAYOUTS), 0
            for m in _HOLE.finditer(layout):
                text += layout[at : m.start()]
                at = m.end()
                if m.group(0) == "#":
                    text += str(self.rng.randint(0, 200))
                    continue
                value = getattr(self, m[1])()
                gold.append((len(text), len(text) + len(value), m[1]))
                text += value
            return text + layout[at:], gold
        kind = pick(KINDS)
        language = pick(list(OPENINGS[kind]) + ["en"] * len(OPENINGS[kind]))
        opening, close = pick(OPENINGS[kind][language]), pick(CLOSES[language])
        if self.rng.random() < 0.12:
            opening = self.plain() + " " + opening
        if opening.endswith(("<", "(")):
            close = ">" if opening.endswith("<") else ")"
        elif close in (">", ")"):
            close = ""
        if self.rng.random() < 0.35 and not opening.endswith(("<", "(")):
            close = f"{self.rng.choice([' ', ' ', ', ', '; '])}{self.prose()}{self.rng.choice(['', '.'])}"
            if self.rng.random() < 0.6 and kind in ("address", "email", "name"):
                opening = "" if self.rng.random() < 0.4 else self.prose() + " "
        value = self.stranger() if kind == "name" and opening.strip() and opening in OPENINGS["name"][language] and self.rng.random() < 0.15 else getattr(self, kind)()
        return opening + value + close, [(len(opening), len(opening) + len(value), kind)]


def training_texts(lexicon: Lexicon, n: int = 4500, seed: int = 42) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Labelled texts: items of every kind in every format among lines that only look like them."""
    make = _Maker(lexicon, seed)
    out = []
    for _ in range(n):
        text, gold = "", []
        for _ in range(make.rng.randint(1, 3)):
            line, items = (make.plain(), []) if make.rng.random() < 0.45 else make.carried()
            text += (" " if make.rng.random() < 0.35 else "\n") if text else ""
            gold += [(len(text) + s, len(text) + e, k) for s, e, k in items]
            text += line
        out.append((text, gold))
    return out
