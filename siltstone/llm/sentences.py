"""Labelled sentences with invented personal items, for training a tagger.

Names are made of syllables, numbers and addresses of the formats of several countries;
what stands around them is everyday correspondence, tables, records and logs in four
languages, filled with words of a public vocabulary. No text of a corpus is used.
"""

from __future__ import annotations

import base64
import re

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"

# Syllables of invented names.
_ON = "b br c ch d dr f fj fr g gr h j k kl l m mb n ny p qu r s sc sh st sz t th tr v w x y z".split()
_VO = "a e i o u ae ai au ei ia io ou oa y ee".split()
_MID = "l m n r s t d v k ll nn rr nd rt st ld lm".split()
_END_G = ["", "", "a", "n", "r", "l", "s", "x", "na", "lle", "ck", "th", "rik", "da", "ne", "dre", "co", "sha"]
_END_F = ["", "n", "r", "l", "s", "x", "ck", "rd", "rt", "lind", "moor", "ra", "ko", "ski", "quist", "worth", "son", "ez", "ovic", "mann", "feld", "berg", "ard", "ier", "oni", "aku", "by", "gate", "holm"]
# Parts of addresses.
_WAYS_EN = "Street St. St Road Rd. Rd Avenue Ave Ave. Lane Ln Close Court Drive Way Place Square Terrace Crescent Row Boulevard Hill Gardens Parkway".split()
_WAYS_FR = ["rue", "avenue", "boulevard", "chemin", "place", "allée", "impasse", "quai", "route", "cours"]
_OF_FR = ["de la ", "du ", "des ", "de l'", "de "]
_WAYS_ES = ["Calle", "Avda.", "Avenida", "Plaza", "Paseo", "C/", "Camino", "Ronda"]
_WAYS_DE = ["straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "ring", "damm"]
_AT_DE = ["Am", "Im", "An der", "Auf dem", "Zum", "Zur", "In der", "Unter den", "Alter", "Neue"]
# Labels of identity and telephone numbers.
ID_LABELS = [
    "SSN", "SSN:", "Social Security No.", "social security number", "tax ID", "tax number", "taxpayer no.", "passport no.", "passport", "Passport:", "NI number", "national insurance no.", "national ID", "identity card",
    "Steuernummer", "Steuer-ID", "Reisepass Nr.", "Pass-Nr.", "Personalausweis", "Ausweis Nr.", "Sozialversicherungsnr.", "numéro fiscal", "n° de sécurité sociale", "NIR", "carte d'identité", "passeport",
    "DNI", "NIE", "NIF:", "pasaporte", "documento", "número de la Seguridad Social",
]
TEL_LABELS = ["Tel.", "Tel:", "tel.", "phone", "Phone:", "mobile", "Mobile:", "fax", "cell", "T:", "Telefon", "Telefon:", "Mobil", "Handy", "Rufnummer", "tél.", "Tél. :", "téléphone", "portable", "teléfono", "móvil", "Tfno.", "hotline", "WhatsApp"]

# Words that often open a sentence.
_OPENERS = "Der Die Das Ein Eine Kein Ohne Mit Für Bei Nach Jede Jeder Ist Sind Wird Wenn Im Am Unser Le La Les Un Une Sans Avec Chaque Pour Dans Notre El Los Las Una Sin Con Cada Para En Nuestro The A No Each Any When If This Our Every Larger Please".split()


class Writer:
    """Collects text with one tag a character: outside, or begin and inside of a kind."""

    def __init__(self, seed: int, vocabulary: str = VOCABULARY):
        self.rng = np.random.default_rng(seed)
        self.text, self.tags = "", []
        self.words, self.capitals = _words(vocabulary)

    def pick(self, options):
        return options[int(self.rng.integers(len(options)))]

    def odds(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def number(self, digits: int) -> str:
        return "".join(str(int(d)) for d in self.rng.integers(0, 10, digits))

    def letter(self) -> str:
        return chr(65 + int(self.rng.integers(26)))

    def word(self) -> str:
        # Frequent words come first in the vocabulary and are drawn more often.
        return self.words[int(len(self.words) * self.rng.random() ** 2)]

    def fill(self, template: str, label: str = "") -> str:
        """Codes of a template: w word, C with a capital, N one that has it by nature, U in capitals, S invented, h hexadecimal, digits a number of that many."""

        def put(m: re.Match) -> str:
            c = m[1]
            if c.isdigit():
                return self.number(int(c))
            if c == "w":
                return self.word()
            if c == "C":
                return self._cap(self.word())
            if c == "N":
                return self.pick(self.capitals)
            if c == "U":
                return self.word().upper()
            if c == "S":
                return self._cap(self._syllables(_END_F))
            if c == "h":
                return "".join(self.pick("0123456789abcdef") for _ in range(int(self.rng.integers(5, 9))))
            if c == "l":
                return label
            return {"L": self.letter, "A": lambda: self.pick("ABCD"), "X": lambda: self.pick("XYZ"), "E": lambda: self.pick("12")}[c]()

        return re.sub(r"\{(\w{1,2})\}", put, template)

    def choose(self, templates: list[str]) -> str:
        return self.fill(self.pick(templates))

    def some(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(int(self.rng.integers(least, most + 1))))

    def put(self, text: str, kind: str | None = None) -> None:
        n = 0 if kind is None else KINDS.index(kind)
        self.text += text
        self.tags += [0] * len(text) if kind is None else [1 + 2 * n] + [2 + 2 * n] * (len(text) - 1)

    # ------------------------------------------------------------ items

    def _syllables(self, ends: list[str]) -> str:
        out = self.pick(_ON) if self.odds(0.8) else ""
        out += self.pick(_VO)
        if self.odds(0.55):
            out += self.pick(_MID) + self.pick(_VO)
        out += self.pick(ends)
        return out if len(out) > 2 else out + self.pick(["na", "ris", "ton"])

    def given(self) -> str:
        w = self._syllables(_END_G) if self.odds(0.9) else self.word()
        return w[0].upper() + w[1:]

    def family(self) -> str:
        w = self._syllables(_END_F)
        if self.odds(0.25):
            w = self.word()[:6] + self.pick(_END_F[9:])
        w = w[0].upper() + w[1:]
        if self.odds(0.06):
            w = self.pick(["O'", "Mc", "D'", "De"]) + w
        return f"{w}-{self._cap(self._syllables(_END_F))}" if self.odds(0.07) else w

    @staticmethod
    def _cap(w: str) -> str:
        return w[0].upper() + w[1:]

    def name(self) -> str:
        g, f = self.given(), self.family()
        kind = self.rng.random()
        if kind < 0.62:
            return f"{g} {f}"
        if kind < 0.74:
            return f"{f}, {g}" + (f" {self.letter()}." if self.odds(0.2) else "")
        if kind < 0.84:
            return f"{g} {self.letter()}. {f}"
        if kind < 0.9:
            return f"{f.upper()}, {g}" if self.odds(0.5) else f"{g} {f.upper()}"
        if kind < 0.96:
            return f"{g} {self.pick(['von', 'de', 'van der', 'del', 'de la', 'da', 'van'])} {f}"
        return f"{g} {self.given()} {f}"

    def email(self) -> str:
        g, f = self.given().lower(), self.family().lower().replace("'", "").replace("-", "")
        user = self.pick([g, f, f"{g}.{f}", f"{g}.{f}", f"{g[0]}{f}", f"{f}_{self.number(2)}", f"{g}+{self.word()}", f"{self.word()}.{self.word()}", f"{g}{self.number(2)}", f"{g[0]}.{f}"])
        host = self.pick(["mail", "office", self.word(), self.word(), self._syllables(_END_F), f"{self.word()}-{self.word()}", self.word() + self.word()])
        end = self.pick(["com", "org", "net", "de", "fr", "es", "io", "co.uk", "edu", "test", "example", "info"])
        if self.odds(0.2):
            host = f"{self.word()}.{host}"
        at, dot = self.pick([("@", ".")] * 7 + [(" [at] ", " [dot] "), ("(at)", "."), ("[at]", "."), (" AT ", " DOT "), (" AT ", " DOT "), (" (at) ", " (dot) "), (" at ", " dot "), ("{at}", "."), (" [at] ", ".")])
        out = user + at + (host + "." + end).replace(".", dot)
        return out.upper() if at == "@" and self.odds(0.08) else out

    def phone(self) -> str:
        return self.choose(
            [
                "+1 {3}-{3}-{4}", "+1 {3} {3} {4}", "+1-{3}-{3}-{4}", "+1-{3}-{3}-{4} ext. {3}", "({3}) {3}-{4}", "{3}.{3}.{4}", "{3}-{3}-{4}", "({3}) {3}-{4} x{2}",
                "+44 {2} {4} {4}", "0{4} {6}", "+44 (0){4} {6}", "+33 {1} {2} {2} {2} {2}", "0{1} {2} {2} {2} {2}", "0{1}.{2}.{2}.{2}.{2}", "0{2}/{7}", "0{3}-{8}", "0{2} / {4} {4}",
                "+49 {3} {7}", "+49 (0){2} {4} {4}", "0049 {2} {8}", "{3} {3} {3}", "+34 {3} {2} {2} {2}", "+34 {9}", "9{2} {2} {2} {2}", "6{8}", "+{2}{9}",
            ]
        )

    def identity(self) -> str:
        return self.choose(
            [
                "{3}-{2}-{4}", "{3}-{2}-{4}", "{3} {2} {4}", "{9}", "{9}", "{L}{L} {2} {2} {2} {A}", "{L}{L}{6}{A}", "{L}{8}", "{L}{8}", "{2}{L}{L}{5}", "{2}{L}{L}{5}", "{2}.{3}.{3}-{L}", "{8}{L}",
                "{8}-{L}", "{X}{7}{L}", "{2} {3} {3} {3}", "{2} {6} {L} {3}", "{E} {2} {2} {2} {3} {3} {2}", "{E}{12}", "{11}", "{2}{6}{L}{3}",
            ]
        )

    def place(self) -> str:
        a = self._cap(self._syllables(_END_F))
        return self.pick([a, a, a, f"{a} {self._cap(self.word())}", f"{a}-sur-{self.family()}", f"Bad {a}", f"San {a}"])

    def address(self) -> str:
        n = str(int(self.rng.integers(1, 250))) + (self.pick("abc") if self.odds(0.1) else "")
        own = self._cap(self.word()) if self.odds(0.6) else self.family()
        town, gap = self.place(), self.pick([", "] * 6 + [",\n", "\n"])
        code = self.pick([self.number(5), self.number(5), f"{self.letter()}{self.letter()}{self.number(1)} {self.number(1)}{self.letter()}{self.letter()}", f"D-{self.number(5)}"])
        where = self.pick([f"{town} {code}", f"{code} {town}", town])
        kind = self.rng.random()
        if kind < 0.36:
            street = f"{n} {self.pick(['', '', 'Old ', 'New ', 'North ', 'Upper '])}{own}{self.pick(['', '', ' ' + self._cap(self.word())])} {self.pick(_WAYS_EN)}"
            street += self.pick(["", "", "", f", Flat {self.number(2)}", f", Apt. {self.number(1)}{self.letter()}", f"{gap}Suite {self.number(3)}"])
        elif kind < 0.48:
            street = f"{self.pick(['P.O. Box', 'PO Box', 'P. O. Box', 'Post Office Box', 'Postfach', 'Boîte postale', 'B.P.', 'BP', 'Apartado', 'Apdo.', 'Apartado de Correos'])} {self.number(int(self.rng.integers(2, 6)))}"
        elif kind < 0.64:
            street = f"{n}{self.pick(['', '', ' bis', ' ter', ','])} {self.pick(_WAYS_FR)} {self.pick(_OF_FR)}{own}"
        elif kind < 0.8:
            street = f"{self.pick(_WAYS_ES)} {self.pick(['', '', 'del ', 'de la ', 'de '])}{own}{self.pick([' ', ', ', ', nº '])}{n}" + self.pick(["", "", ", bajo", f", {self.number(1)}º {self.letter()}", ", 1º izq.", ", 2º dcha."])
        elif kind < 0.92:
            street = self.pick([f"{own}{self.pick(_WAYS_DE)} {n}", f"{own}{self.pick(_WAYS_DE)} {n}", f"{own}-{self.family()}-{self.pick(['Straße', 'Allee', 'Weg', 'Platz'])} {n}", f"{own}er {self.pick(['Straße', 'Weg', 'Platz', 'Allee'])} {n}"])
        else:
            street = f"{self.pick(_AT_DE)} {own} {n}"
        return street + (gap + where if self.odds(0.85) else "")

    # ------------------------------------------------------------ what stands around

    def _frame(self, kind: str, item: str) -> None:
        """A line of correspondence around an item."""
        put, pick, label = self.put, self.pick, ""
        if kind == "name":
            ahead, behind = pick(
                [
                    ("", " chairs the {w} committee."), ("", " will bring the {w} on Friday."), ("", " said:"), ("", " {w} the {w} {w} last year."), ("", " {w} {w} {w}."), ("{C} {w} and {w} for ", "."), ("{C} {w} to ", " for {w} the {w}."), ("{C}: ", ""), ("{C}: ", "\n"), ("{N}: ", "\n"), ("{w} {w} ", " about this"), ("// {w} ", " {w}"), ("> ", " wrote:"), ("", " hat den {w} {w} {w}."), ("", " a {w} le {w} hier."), ("", " {w} el {w} ayer."), ("", " wrote on Monday:\n> "), ("", " moved the {w} to the {w}."), ("Please welcome ", ", our new {w}."), ("Dear ", ",\n"), ("Best regards,\n", "\n"),
                    ("Kind regards, ", ""), ("Minutes: ", "\n"), ("photo by ", ""), ("I spoke with ", " about the {w}."), ("as ", " told us, the {w} is late."), ("many thanks to ", " for the {w}!"), ("Attn: ", ""), ("c/o ", "\n"), ("approved by ", " in {w}"), ("Dr. ", " is on leave."),
                    ("speaker: ", ""), ("my name is ", ""), ("ask ", " whether the {w} is ready"), ("The prize went to ", "."), ("Mr ", " called about the {w}."), ("translated by ", ", 2nd edition"), ("contact ", " for details"), ("Responsible: ", "; due soon"), ("reported by ", ""), ("(", ")"),
                    ("", " hat den {w} gestern gebracht."), ("Sehr geehrte Frau ", ",\n"), ("Herr ", " kommt später."), ("Mit freundlichen Grüßen\n", "\n"), ("Teilnehmer: ", ""), ("laut ", " ist der {w} fertig"), ("Dank an ", " für die Hilfe."), ("Bearbeiter: ", ""), ("Frag ", " danach."),
                    ("", " dirige l'atelier de {w}."), ("Mme ", " arrive demain."), ("Cordialement,\n", "\n"), ("selon ", ", le {w} est prêt"), ("présenté par ", ""), ("Merci à ", " pour son aide."), ("Responsable : ", ""), ("", " a vu le {w} ce matin."),
                    ("", " dirige el taller de {w}."), ("Estimado ", ":\n"), ("Un saludo,\n", "\n"), ("según ", ", el {w} está listo"), ("gracias a ", " por la ayuda."), ("Sra. ", " llega mañana."), ("Encargado: ", ""), ("", " vio el {w} ayer."),
                ]
            )
        elif kind == "email":
            ahead, behind = pick(
                [
                    ("Send the form to ", "."), ("reply to ", " before noon"), ("e-mail: ", ""), ("Email ", " with the {w}"), ("<", ">"), ("mailto:", '"'), ("you can reach us at ", "."), ("invoice copies go to ", ", not to the {w}"), ("Kontakt: ", ""), ("Bitte an ", " schicken."), ("E-Mail an ", ""),
                    ("écrivez à ", " svp"), ("courriel : ", ""), ("adresse : ", "."), ("escriba a ", "."), ("correo: ", ""), ("login failed for ", " ({w})"), ("user ", " signed in from {w}"), ("cc ", ""), ("", " bounced"), ("To: ", "\n"), ("(", ")"),
                ]
            )
        elif kind == "phone":
            label = pick(TEL_LABELS)
            ahead, behind = pick(
                [
                    ("{l} ", ""), ("{l} ", "."), ("{l} ", ", {w}"), ("{l}: ", "\n"), ("ring ", " after six."), ("call us on ", " about the {w}"), ("dial ", " and wait."), ("text ", " instead"), ("the number is ", "."), ("reach the desk at ", ", then the {w}"), ("erreichbar unter ", "."),
                    ("Bitte ", " anrufen."), ("joignable au ", "."), ("appelez le ", " demain"), ("llame al ", "."), ("Emergency: ", ""), ("out of hours ", ""), ("☎ ", ""), ("can be called on ", "."), ("(", ")"), ("| ", " |"),
                ]
            )
        elif kind == "id_number":
            label = pick(ID_LABELS) + pick(["", "", "", " n°", " Nr.", " no."])
            ahead, behind = pick([("{l} ", ""), ("{l} ", "."), ("{l} ", ", {w}"), ("{l}, ", ", {w} {w}"), ("({l} ", ")"), ("my {l} is ", ", {w}"), ("the {l} ", " was on the {w}"), ("{l}: ", "\n"), ("mit {l} ", ""), ("le {l} ", "."), ("el {l} ", "."), ("with {l} ", " and {w}")])
        else:
            ahead, behind = pick(
                [
                    ("Deliver to ", "."), ("We moved to ", " in {w}."), ("the shop at ", ""), ("Address: ", ""), ("Office: ", "\n"), ("lives at ", "."), ("bill to\n", "\n"), ("Invoice\n", "\n\n"), ("", "\n"), ("Return the {w} to ", "."), ("parcels go to ", "."), ("wohnhaft ", ""), ("Lieferung an ", "."),
                    ("Anschrift: ", "\n"), ("geht an ", "."), ("habite au ", "."), ("livrer au ", ""), ("Adresse : ", "\n"), ("vive en ", "."), ("enviar a ", "."), ("Domicilio: ", ""), ("> ", "\n"), ("| ", " |"), ("(", ")"),
                ]
            )
        put(self.fill(ahead, label))
        if kind == "name" and self.odds(0.3) and ahead in ("my name is ", "Dear ", "Mr ", "Mme ", "Herr ", "ask ", "I spoke with ", "many thanks to ", "c/o ", "contact "):
            item = item.lower()
        put(item, kind)
        put(self.fill(behind, label))

    def _item(self, kind: str) -> str:
        return {"email": self.email, "phone": self.phone, "id_number": self.identity, "address": self.address, "name": self.name}[kind]()

    def _record(self) -> None:
        """Several items in a table row, a record, a trailer or a separated line."""
        put, pick = self.put, self.pick
        shape = int(self.rng.integers(6))
        kinds = [KINDS[k] for k in self.rng.permutation(5)[: int(self.rng.integers(2, 5))]]
        if shape == 0:
            put("| " if self.odds(0.8) else "")
            for n, k in enumerate(kinds):
                put(" | " if n else "")
                put(self._item(k).replace("\n", " "), k)
            put(" |" + pick(["", "\n"]))
        elif shape == 1:
            keys = {"email": ["mail", "email", "e_mail"], "phone": ["tel", "phone", "mobile"], "id_number": ["ssn", "tax_id", "passport"], "address": ["address", "street"], "name": ["name", "customer", "full_name"]}
            put(pick(["", f"{self.word()}=", f"{self.word()} "]) + "{")
            for n, k in enumerate(kinds):
                put(f'{", " if n else ""}"{pick(keys[k])}": "')
                put(self._item(k).replace("\n", ", "), k)
                put('"')
            put("}")
        elif shape == 2:
            put(f"{pick(['Tested', 'Acked', 'Suggested', 'Signed-off', 'Reviewed', 'Approved', 'Written', 'Checked'])}-by: ")
            put(self.name(), "name")
            if self.odds(0.7):
                put(" <")
                put(self.email(), "email")
                put(">")
            put("\n")
        elif shape == 3:
            put(pick(["Contact: ", "Sales: ", "Kontakt: ", "Contacto: ", "Contact : ", f"{self._cap(self.word())}: ", ""]))
            put(self.name(), "name")
            put(pick([", ", " - ", "; ", " / "]) + pick(TEL_LABELS) + " ")
            put(self.phone(), "phone")
            put(pick(["", "\n", "."]))
        elif shape == 4:
            sep = pick([";"] * 5 + [",", "\t"])
            put(f"{self.number(int(self.rng.integers(1, 5)))}{sep}" if self.odds(0.85) else "")
            put(f"{self.family()}{sep}{self.given()}" if self.odds(0.75) else f"{self.given()}{sep}{self.family()}", "name")
            put(sep)
            k = pick(["id_number", "id_number", "id_number", "phone", "email"])
            put(self._item(k), k)
            put(sep + pick([self.word(), self.number(2)]) + pick(["", "\n"]))
        else:
            put(f'<a href="mailto:')
            put(self.email(), "email")
            put('">')
            put(self.name(), "name")
            put("</a>")

    def _lookalike(self) -> None:
        """What resembles an item and is none."""
        self.put(
            self.choose(
                [
                    "git@{w}.{w}.org:{w}/{w}.git", "ssh://git@{w}.{w}.net/{w}", "@{w}/{w}@{1}.{2}.{1}", "`@{w}_{w}`", "@{w} and @{w}{1}", "pip install {w}=={1}.{2}", "https://{w}.{w}.com/{w}?{w}={4}",
                    "{2}.{2}.{3}.{1}:{4}", "10.{1}.{2}.{3}", "192.168.{1}.{2}:{4} since 20{2}-{2}-{2} {2}:{2}:{2}", "20{2}-{2}-{2}T{2}:{2}:{2}Z", "v{1}.{2}.{1}", "version {1}.{2}.{4}",
                    "order {4}-{4}-{2}", "Order {4}-{4}-{2} of the {w}", "{4}-{4}-{2} {w}", "{3}-{2} rows of ticket {9}", "order no. {9}", "{w} order {3}-{7}", "invoice {3}-{2}-{4} rows", "ticket {9}", "ticket #{6}", "build {10} of the {w}", "Build {8}", "case {4}/{2}", "parcel {12}", "batch {9} done", "job {8} took {4} ms",
                    "commit {3}a{2}f{4}", "commit {7}", "id {8}-{4}-4{3}-a{3}-{12}", "{4} of {6} rows", "{3}-{2} rows of {w} {9}", "ISBN {3}-{1}-{5}-{3}-{1}", "0x{8}", "size {10} bytes", "{1}.{3} s, {4} MB",
                    "{C} {C} Street is the name of the {w}.", "The {C} Road {w} opens soon.", "the {C} Lane release", "{C} Court is a code name", "project {C} Avenue", "Box {2} of the {w}", "page {3}", "room {3}, floor {1}", "chapter {2}",
                    "# {C} {C}\n", "## {C} {C} {C}\n", "## The {C} {C}\n", "**{C} {C}**", "the {C} {C} project", "The {C} {C} and the {C} {w}", "a {C} {C} {w}", "The {S} {C} and the {C} {C}", "the {S} {C}", "der {S} {N} und", "Anyone {C} a {w}", "{C} {1}.{1} of {C} {C} Studio", "powered by {C} {C} {1}", "Release {1} of {S} {C}",
                    "{S} Engine {1}", "{S} Suite", "{C}{C}", "`{C}{C}`", "`{C}.{w}`", "`{w}_{w}`", "{w}/{w}_{w}.py", "{U} {U} {U}", "THE {U} IS {U} AT {3}",
                    "{U}_{U}={4}", "INFO {w}_{w}: {w} {w} at {3}a{2}", "if {w} > {3}: {w}({w}, {2})", '{w}("{w} {w} is {w}")', "Der {C} {w} den {C} {C} nicht.", "Die {C} und das {C} der {C}", "Bitte {C} prüfen",
                    "Ist {C} {w}, wird {C} {w}.", "Le {C} de la {C}", "Chaque {w} est {w}.", "El {C} del {C}", "Nous avons {w} la {w}.", "Wir haben die {C} auf {4} gesetzt.", "Änderungen an {C} müssen warten.", "{2}:{2} {w}", "{1}/{2}/20{2}",
                    "Monday and Tuesday", "Only {C} {w} here", "{C} {w}. {C} {w}.", "{C}, {w} and {w}", "See {C} for {w}", "- {C}: {C} {w}", "{C}: {C} {C}", "[{C} {C}](https://{w}.org)", "{C} asked why {w} {w}",
                ]
            )
        )
        self.put(self.pick(["", " ", ".", "\n"]))

    def filler(self) -> None:
        """A sentence of plain words, here and there with capitals, marks, code or numbers."""
        words = self.some(3, 12).split(" ")
        capitals = self.pick([0.02, 0.05, 0.12])
        for k in range(len(words)):
            r = self.rng.random()
            if r < 0.15:
                words[k] = self.choose(["`{w}_{w}`", "`{C}{C}`", "`{w}{C}`", "`{C}.{w}`", "{1}", "{2}", "{4}", "{3}", "{1}.{3}", "{1}.{2}.{1}", "{w},", "{w};", "{w}:", "{w} -", "{w}-{w}", "{C}{C}", "{w}/{w}.py", "`{w}/{w}_{w}.md`", "{h}", "{w}'s", "l'{w}", "d'{w}", "({w})", "*{w}*", "{3} {C}", "{3} MB", "{4} {w}", "{2} {C} {w}", "{3} {w}", "{4} {N}", "{2} ms"])
            elif r < 0.3:
                words[k] = self.pick("the a of and in is der die das den dem ein eine zu ist und von le la les un une du des est et à de el los las una y en es del se".split())
            elif r < 0.3 + capitals:
                words[k] = self.choose(["{C}", "{N}"]) if words[k - 1].islower() else self.choose(["{C}"])
        if self.odds(0.25):
            words[0:1] = [self.pick(_OPENERS).lower(), self.choose(["{N}", "{C}", "{w}"])]
        first = words[0]
        self.put(self.choose([""] * 8 + ["{C}: ", "{C}: ", "{L}: ", "{N}: "]) + " ".join([first[0].upper() + first[1:], *words[1:]]) + self.pick([".", ".", ".", "?", ":", "", "!"]))

    def code(self) -> None:
        """A line of a program, a log or a shell."""
        self.put(
            self.choose(
                [
                    "{w}_{w} = {w}({w}, {3})", "{w} = sorted({w}, key=lambda {w}: ({w}[{1}], -{3}))", "if {w}({w}_{w}) > {2}: {w}()", 'log("{w} %d of %d", {3}, {w}_{w})', "{w}[{1}], {w}[-{2}] = {w}, {4}", 'assert {w} == {3}, "{w} {w}"', "for {w} in {w}[{1}:{2}]:", "const {w}{C} = {w}.{w}({3}, {w});",
                    "return {w} + {w} * {2}", 'raise {C}{C}("{w} is {w}")', "import {w}.{w}", "INFO {w}_{w}: {w} {w} at {h}", "WARN {w} {h} -> {h}", "ERROR {w}: {w} {w} at {h}", "[{2}:{2}:{2}] {w} {w} in {3} ms", "$ {w} --{w} {3} --{w}={w}", 'f"{w}: {3}"', '{{"{w}": {3}, "{w}": "{w}"}}', "{w}({4}, {w})", "<{w} {w}=\"{3}\">{w}</{w}>",
                    "@@ -{2},{1} +{2},{1} @@ {w}", "{w}: [{1}, {2}, {3}]", "sha {h}{h}{h}", "{w}.{w}.{w}({w} => {w}.{w}, {2})", "SELECT {w} FROM {w} WHERE {w} = {4}", "&#{2};{C}{C}&#{2}; {w} {2} {w}", "<p>{C} {w} {2} {w}.</p><p>{C} {w}", "```\n", "raise_if({w} < {2}, \"{w} is {w}\")",
                ]
            )
        )
        self.put(self.pick(["\n", "\n", ""]))

    def gap(self) -> None:
        self.put(self.pick([" ", " ", " ", " ", "\n", "\n", "\n\n", "\r\n", "\n- ", "\n> ", "\n1. ", "\n# ", "\n    ", "\n// "]))


def _words(path: str) -> tuple[list[str], list[str]]:
    """Words that the vocabulary holds with a blank before them, frequent ones first: in small letters, with a capital."""
    small, capital = [], []
    with open(path, "rb") as lines:
        for line in lines:
            raw = base64.b64decode(line.split(b" ")[0])
            if raw[:1] != b" " or not 3 < len(raw) < 16:
                continue
            try:
                word = raw[1:].decode()
            except UnicodeDecodeError:
                continue
            # Latin letters; only those that keep their length in capitals.
            if word.isalpha() and all(ord(c) < 0x250 for c in word) and len(word.upper()) == len(word):
                if word.islower():
                    small.append(word)
                elif word.istitle():
                    capital.append(word)
    return small, capital


def examples(count: int, size: int, seed: int = 17, vocabulary: str = VOCABULARY) -> list[tuple[str, np.ndarray]]:
    """Labelled stretches of at most ``size`` characters: items among sentences without any."""
    out = []
    w = Writer(seed, vocabulary)
    while len(out) < count:
        w.text, w.tags = "", []
        for _ in range(int(w.rng.integers(2, 6))):
            kind = w.rng.random()
            if kind < 0.3:
                w.filler()
            elif kind < 0.38:
                w.code()
            elif kind < 0.55:
                w._lookalike()
            elif kind < 0.72:
                w._record()
            else:
                k = w.pick(KINDS + ("name", "name", "name", "address", "id_number", "phone"))
                w._frame(k, w._item(k))
            w.gap()
        text, tags = w.text, np.array(w.tags, np.int8)
        r = w.rng.random()
        if r < 0.05:
            text = text.upper()
        elif r < 0.09:
            text = text.replace(" ", "\u00a0")
        if len(text) != len(tags):
            continue  # a letter that grows with its case
        lo = int(w.rng.integers(0, max(1, len(text) - size + 1)))
        text, tags = text[lo : lo + size], tags[lo : lo + size].copy()
        if lo and len(tags) and tags[0] and tags[0] % 2 == 0:
            tags[0] -= 1  # cut inside an item: what is left of it begins here
        out.append((text, tags))
    return out
