"""Labelled texts for ``pii``, made up from random syllables, formats and frames, with look-alikes that are no mention.

Words and names come from languages made up text by text: each draws its own letters, syllables, small words and habits, so that
no ending and no word of theirs tells a name.  Labels, street words and number formats are those in public use.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

from webloom.llm.pii import BODIES, CLOSED

_CLOSED, _BODIES = sorted(CLOSED), sorted(BODIES)
_VOWELS = ["a", "e", "i", "o", "u", "ä", "ö", "ü", "é", "è", "á", "í", "ó", "ã", "y", "ę", "å", "ø", "ei", "ie", "au", "ou", "ia", "io", "ua"]
_ONSETS = ["", "b", "c", "d", "f", "g", "h", "j", "k", "l", "m", "n", "p", "q", "r", "s", "t", "v", "w", "x", "z", "br", "ch", "dr", "fl", "gr", "kh", "kl", "ll", "mc", "nh", "ph", "sch", "sh", "sl", "st", "str", "sz", "th", "tr", "vl", "wr", "zh", "ç", "š", "ž", "ñ"]
_CODAS = ["", "", "", "n", "r", "s", "l", "m", "t", "d", "k", "ng", "ck", "ff", "gh", "ll", "nd", "ns", "rd", "rt", "sch", "ss", "st", "tz", "x", "z", "ń", "ł"]
_CYRILLIC = (["а", "е", "и", "о", "у", "я", "ы", "ю"], ["", "б", "в", "г", "д", "ж", "з", "к", "л", "м", "н", "п", "р", "с", "т", "х", "ч", "ш", "бр", "ст", "тр"], ["", "", "н", "р", "й", "в", "к", "л", "м", "т", "сть", "ц"])


class _Language:
    """A random language: common words, of which nouns may be written with capitals, and makers of names."""

    def __init__(self, r: random.Random):
        self.r = r
        v, o, c = _CYRILLIC if r.random() < 0.12 else (_VOWELS, _ONSETS, _CODAS)
        self.v, self.o, self.c = r.sample(v, min(len(v), 7)), r.sample(o, min(len(o), 16)), r.sample(c, min(len(c), 8))
        self.capitals = r.random() < 0.25
        self.nouns, self.others = [self.word(1, 3) for _ in range(60)], [self.word(1, 3) for _ in range(80)]
        self.small = r.sample(_CLOSED, 20) if r.random() < 0.7 else [self.word(1, 1) for _ in range(20)]
        self.names = [self.word(1, 3).capitalize() for _ in range(25)]

    def word(self, low: int, high: int) -> str:
        r = self.r
        while True:
            w = "".join(r.choice(self.o) + r.choice(self.v) + r.choice(self.c) * (r.random() < 0.6) for _ in range(r.randint(low, high)))
            if 2 <= len(w) <= 14:
                return w

    def proper(self) -> str:
        return self.word(2, 4).capitalize()

    def noun(self) -> str:
        w = self.r.choice(self.nouns)
        return w.capitalize() if self.capitals else w

    def phrase(self, n: int) -> list[str]:
        r = self.r
        return [w for _ in range(n) for w in ([r.choice(self.small)] * (r.random() < 0.6) + [r.choice(self.others)] * (r.random() < 0.6) + [self.noun()])]

    def sentence(self) -> str:
        r = self.r
        words = self.phrase(r.randint(2, 4))
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(([self.proper()], [r.choice(self.small), self.proper()], [str(r.randrange(2, 400))], [self.proper().upper()], [self.proper() + "'s"], [r.choice(("May", "Monday", "I", "TV", "EU"))]))
        words[0] = words[0][:1].upper() + words[0][1:]
        if r.random() < 0.06:
            words = [w.upper() if len(w) > 3 else w for w in words]
        text = " ".join(words)
        if r.random() < 0.2:
            at = text.find(" ", len(text) // 2)
            text = text[:at] + r.choice((",", ":", " –", ";")) + text[at:] if at > 0 else text
        return text + r.choice((".", ".", ".", "!", "?", ""))

    def name(self) -> str:
        r = self.r
        g = r.choice(self.names) if r.random() < 0.6 else self.word(1, 3).capitalize()
        f = self.word(1, 4).capitalize()
        if r.random() < 0.08:
            f = r.choice(("O'", "Mc", "Mac", "D'", "El-", "Al-")) + f
        elif r.random() < 0.08:
            f += "-" + self.word(1, 3).capitalize()
        form = r.random()
        if form < 0.46:
            out = f"{g} {f}"
        elif form < 0.53:
            out = f"{g} {r.choice(('de', 'di', 'van', 'von', 'da', 'del', 'van der', 'bin', 'la', 'dos', 'zu'))} {f}"
        elif form < 0.59:
            out = f"{g}-{r.choice(self.names)} {f}"
        elif form < 0.66:
            out = f"{f}, {g}"
        elif form < 0.73:
            out = f"{g} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {f}"
        elif form < 0.77:
            out = f"{g} {r.choice(self.names)} {f}"
        elif form < 0.83:
            out = f"{g[0]}. {f}"
        elif form < 0.86:
            out = f"{g[0]}. {r.choice('ABCDEFGHJKLM')}. {f}"
        elif form < 0.94:
            return f"{g} {f[0]}."
        else:
            out = f"{g} {f}".upper()
        return out


def _digits(r: random.Random, shape: str) -> str:
    return "".join(str(r.randrange(10)) if c == "#" else r.choice("ABCDEFGHJKLMNPQRSTXYZ") if c == "@" else c for c in shape)


_PHONES = ["+## ## ##### ###", "+## ## #######", "+#-###-###-####", "+# (###) ###-####", "+# (###) ####-####", "+# ### ### ####", "00##-##-########", "00## ## ### ## ##", "0##/#####-###", "0##/#######", "+## # ## ## ## ##", "+## ### ## ## ##", "+## ### ### ###", "###-###-####", "###.###.####", "(###) ###-####", "(0##) #### ####", "1.###.###.####", "1-###-###-####", "0#.##.##.##.##", "0# ## ## ## ##", "0## #### ####", "0#### ######", "+## #### ######", "+## # #### ####", "+##### #### ####", "+####### #####", "+## (0)## ######", "0### ######", "+############", "+###########", "0##########"]
_IDS = ["@@ ## ## ## @", "@@######@", "@#######", "@@#######", "########-@", "########@", "@########", "###-##-####", "######-####", "######+####", "1 ## ## ## ### ### ##", "2 ## ## ## ### ### ##", "## ### ### ###", "###.###.###-##", "###########", "#########", "@#######@"]
_NUMBER_LABELS = ["Order", "Order no.", "Lot", "Batch", "Batch EAN", "EAN", "ISBN", "Invoice", "Ref", "Reference", "Position", "Built", "Version", "Page", "Model", "Serial", "SKU", "Item", "Item no.", "Part no.", "Article", "Tracking", "Ticket", "Room", "Row", "Score", "Bestellung", "Charge", "Modell", "Commande", "Pedido", "Run", "Priced at £", "Price: $", "Chapter"]
_ANY_NUMBERS = ["####-####-##", "#############", "978-#-####-####-#", "####-##-####", "20##-0#-1# 1#:2#:##", "##.####, ##.####", "###-##-@", "#,###.00", "# x ###", "#.##.###", "###", "20##/#####", "### ### ###", "##########", "@#####", "###/##", "#### #### ###", "19##-20##", "##.##.20##", "1#:##", "#.###.###", "### ###", "##-##-##", "##########-#", "20##-##-##"]
_ID_LABELS = ["Passport number: ", "National insurance ", "Tax ID ", "Social security no. ", "ID ", "Personalausweis-Nr. ", "Ausweis-Nr. ", "Passport no. ", "SSN: ", "SSN ", "Steuer-ID ", "DNI ", "NIF: ", "Identity card ", "Passnummer: ", "Numéro de sécurité sociale ", "PESEL ", "ИНН ", "ID no. ", "Pasaporte: "]
_NAME_CUES = ["Written by ", "Review by ", "By ", "I met ", "Dear ", "Name: ", "Contact: ", "Ansprechpartner: ", "Rédigé par ", "Mr ", "Ms ", "Mrs. ", "Dr. ", "Prof. ", "Herr ", "Frau ", "Señora ", "Sr. ", "Mme ", "Kundin ", "Kunde: ", "Customer ", "The applicant ", "Our manager ", "Signed: ", "Author: ", "Autor: ", "Autora: ", "Por ", "Von ", "przez ", "Автор: ", "ask for ", "Attn. ", "Liebe ", "Cher ", "Hola ", "Pan ", "photo by ", "the director ", "her colleague ", "Sincerely,\n", "wrote ", "cc ", "Nombre: ", "Imię i nazwisko: "]


def _phone(r: random.Random) -> str:
    return _digits(r, r.choice(_PHONES)) + (r.choice((" ext. ", " x", " ext ")) + str(r.randrange(10, 9999)) if r.random() < 0.12 else "")


def _plain(w: str) -> str:
    return "".join(c for c in w.lower() if c.isascii() and c.isalpha()) or "box"


def _email(r: random.Random, lang: _Language) -> str:
    g, f, h = _plain(lang.word(1, 3)), _plain(lang.word(1, 3)), _plain(lang.word(1, 4))
    local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}{f}", f"{g}{r.randrange(1, 999)}", f"info.{f}", f, g, f"{g}+{f}", "info", "sales", f"{g[0]}.{f}"])
    domain = r.choice(["mail.", "office.", "m.", "", "", "", ""]) + h + r.choice(["", "", "-" + f]) + r.choice([".example", ".com", ".org", ".net", ".co.uk", ".test", ".de", ".fr", ".pl", ".io", ".example.org"])
    form = r.random()
    spaced, dot = domain.replace(".", r.choice((" dot ", " [dot] ", " (dot) "))), domain
    out = f"{local}@{dot}" if form < 0.66 else f"{local} (at) {dot}" if form < 0.74 else f"{local} @ {dot}" if form < 0.82 else f"{local} [at] {domain.replace('.', ' [dot] ')}" if form < 0.9 else f"{local}(at){dot}" if form < 0.93 else f"{local} {{at}} {spaced}" if form < 0.95 else f"{local} at {domain.replace('.', ' dot ')}"
    return out.upper() if r.random() < 0.08 else out.title() if r.random() < 0.05 else out


def _address(r: random.Random, lang: _Language) -> str:
    s, n, p, z = lang.proper(), r.randrange(1, 260), lang.proper(), _digits(r, "#####")
    street = r.choice(("Street", "Road", "Lane", "Avenue", "Ave.", "Blvd", "Drive", "St.", "Rd", "Way", "Close"))
    end = r.choice((f", {p}", f", {p} {z}", f", {p}, {r.choice(('OH', 'CA', 'TX', 'NY'))} {z}", f", {p} {_digits(r, '@@# #@@')}", f", {z} {p}", ""))
    return r.choice([
        f"{n} {s} {street}{end}", f"{n}{r.choice('ABC')} {s} {street}{end}", f"{n} {r.choice('NSEW')} {s} {street}{end}", f"Unit {n}, {s} {street} {r.randrange(1, 200)}, {p}", f"Apt {n}{r.choice('ABC')}, {r.randrange(1, 300)} {r.choice('NSEW')} {s} {street}{end}", f"Flat {n}, {r.randrange(1, 99)} {s} {street}{end}",
        f"{s}str. {n}, {z} {p}", f"{s}weg {n}, {z} {p}", f"{s}straße {n}{end}", f"{s}allee {n}, {z} {p}", f"{s}platz {n}", f"Am {s} {lang.proper()} {n}, {z} {p}", f"Calle {s} {n}, {r.randrange(1, 9)}º {r.choice('ABC')}, {z} {p}", f"Calle de {s}, {n}, {z} {p}", f"Avenida {s} {n}, {p}",
        f"{n} bis, rue des {s}, {z} {p}", f"{n}, avenue de {s}, {z} {p}", f"{n} rue {s}, {z} {p}", f"ul. {s} {n}/{r.randrange(1, 90)}, {z[:2]}-{z[2:]} {p}", f"ul. {s} {n}, {p}", f"PO Box {n}, {p}", f"P.O. Box {n}", f"Postfach {z}, {p}", f"Rua {s} {n}, {p}", f"Rua da {s}, {n}, {p}", f"Via {s} {n}, {z} {p}",
    ])


def _mention(r: random.Random, lang: _Language) -> list:
    """Parts of a passage: plain strings, and (kind, text) of a mention."""
    n, e, p, a = ("name", lang.name()), ("email", _email(r, lang)), ("phone", _phone(r)), ("address", _address(r, lang))
    i, label, cue = ("id_number", _digits(r, r.choice(_IDS))), r.choice(_ID_LABELS), r.choice(_NAME_CUES)
    words, more, noun = " ".join(lang.phrase(2)), " ".join(lang.phrase(1)), lang.noun()
    kind = r.random()
    if kind < 0.22:
        return [cue, n, r.choice(("\n", ".", f" {words}.", ",\n", f", {more}", f" {more}", f": {words}.", ";", "", f" (ID ", f" at the {noun}", f" {lang.sentence()}", f" {_decoy(r, lang)}"))]
    if kind < 0.34:  # a word with a capital before the name that isn't of it
        first = r.choice((r.choice(lang.small), r.choice(lang.others), lang.noun(), r.choice(("if", "when", "yesterday", "today", "later", "then", "once", "while", "for"))))
        return [first.capitalize() + " ", n, r.choice((f" {words}.", f" {more} {words}.", f", {words}.", f" is away, mail ", f" {more}\n", f" {lang.sentence()}"))]
    if kind < 0.58:  # names without a cue
        start, small = f"{more.capitalize()} ", r.choice(("with", "and", "to", "und", "mit", "et", "con", "y", "com", "für", "pour", lang.word(1, 1), r.choice(lang.others)))
        return r.choice([
            [n], [n], [n], [n, f" {words}."], [n, f" {words}."], [n, f" {r.choice(lang.others)} {lang.proper()}."], [n, f" {r.choice(lang.others)} {lang.proper()}."], [n, ";", e, ";", p, "\n"], [start, n, f" {words}."], [n, f", {more}, {words}."], ["— ", n, f", {words}"], [n, "\n"], [n], [f"{start}{words}, ", n, "."], [f"{noun.capitalize()}: ", n, "\n"], ["* ", n, f" ({more})\n"], [n, " & ", ("name", lang.name()), f" {words}."],
            [f"{start}{small} ", n, f" {more}."], [f"{start}{small} ", n, " and ", ("name", lang.name()), "."], [f"{start}{words}, ", n, f", {more}."], [f"{start}{lang.proper()} {small} ", n, "."], [n, ";", e, ";", p, "\n"], [n, r.choice((";", " |", ", ")), f" {words}\n"], [start, n, " ", r.choice(_CLOSED), f" {lang.proper()}."],
        ])
    return r.choice([
        ["Name: ", n, "\nPhone: ", p, "\nMail: ", e, "\n"], ["Our manager ", n, " answers on ", p, f" {more}."], [cue, n, r.choice((", joignable au ", ", Telefon ", ", tel. ", " / ")), p], [label, i, " belongs to ", n, "."], [label, i, " belongs to ", n, f" {_decoy(r, lang)}"], ["Ring ", p, " and ask for ", n, "."],
        [f"{more.capitalize()} write to ", n, " at ", e, " or call ", p, "."], ["If ", n, " is away, mail ", e, "."], ["Deliver to: ", n, ", ", a, ", phone ", p], ["The applicant ", n, " (ID ", i, ") lives at ", a, "."], ["Returns go to ", a, ", attention of ", n, "."],
        [n, ";", e, ";", p, "\n"], ["Kundin ", n, ", " + label, i, ", ", a], [label, i, f" {more}."], [label, i, "\n"], [label, i, f" {words}"], ["Visit us at ", a, "."], ["Anschrift: ", a, "\n"], ["Adresse: ", a, "\n"], [f"{words.capitalize()} from ", a, f" {more}"],
        [f"mail ", e], ["Contact: ", e], ["mailto:", e], ["<", e, ">"], ["cc ", e, ", ", ("email", _email(r, lang))], [f"{more.capitalize()} ", e, f" {more}."], ["E-Mail: ", e, "\n"], [f"{words.capitalize()} ", e, "."], ["Escríbenos a ", e, " o llama al ", p], ["Tel. ", p], ["Phone: ", p, "\n"], ["Call ", p, f" {more}."], [f"{words.capitalize()} ", p, "."], ["Fax ", p], ["(", p, ")"], [a, "\n"], [f"{words.capitalize()} ", a, "."],
    ])


def _decoy(r: random.Random, lang: _Language) -> str:
    x, y, words = lang.proper(), lang.proper(), " ".join(lang.phrase(2))
    kind = r.random()
    if kind < 0.5:
        shape = r.choice(_ANY_NUMBERS) if r.random() < 0.75 else r.choice(_PHONES + _IDS)
        return f"{r.choice(_NUMBER_LABELS)} {_digits(r, shape)}{r.choice(('.', f' {words}.', ' is sold out.', ', ' + words, chr(10)))}"
    return r.choice([
        f"Follow @{x} {words}.", f"See {x.lower()}@2x.png {words}.", f"npm i @{_plain(x)}/{_plain(y)}@{r.randrange(9)}.{r.randrange(99)}.{r.randrange(9)} first.", f"https://{_plain(x)}.example/a_b-c?q=%C3%A9&user=x@y.z", f"https://user@{_plain(x)}.example/x", f"{r.choice(('In', 'From', 'Near', 'Aus', 'En'))} {x} {y} {words}.", f"{words.capitalize()} {r.choice(('in', 'near', 'aus', 'from', 'de', 'à'))} {x} {y}.",
        f"{x}, {y} and {lang.proper()} {words}.", f"{lang.noun()} {x}.", f"{x.upper()} {words.upper()}", f"{lang.noun().upper()} de {lang.noun().upper()} {r.choice(('em', 'in', 'en'))} {x}: {words}.", f"The {x} {r.choice(('Road', 'Street', 'Lane'))} {words} {r.randrange(2, 40)}.", f"{words.capitalize()} at noon and dot the {lang.noun()}.", f"{_digits(r, '#### #### ###')} {words}.",
        f"{r.choice(lang.small).capitalize()} {lang.noun().capitalize()} {r.choice(('aus', 'in', 'from'))} {x} {words}.", f"{r.choice(lang.others).capitalize()} {lang.noun().capitalize()}{r.choice((',', ''))} {words}.", f"{r.choice(('Tax ID', 'Terms of Use', 'Privacy Policy', 'Read More', 'Contact Us', 'New Year', 'Monday May 4', 'User ID', 'VAT ID', 'Sign In', 'Open Source'))} {words}", f"½ ² Ⅷ ٣ ① {_digits(r, '#############')} 0x1F", f"Table {r.randrange(1, 30)}, {x}, {r.randrange(1900, 2020)}.", f"{lang.sentence()} {x}, {words}.",
    ])


def labelled_texts(n: int, seed: int) -> Iterator[tuple[str, set[tuple[str, int, int]]]]:
    """``n`` texts, each with the set of ``(kind, start, end)`` of its mentions."""
    r = random.Random(seed)
    lang = _Language(r)
    for k in range(n):
        if k % 40 == 0:
            lang = _Language(r)
        text, truth = "", set()
        for _ in range(r.choice((1, 1, 2, 3, 4, 5))):
            kind = r.random()
            parts = _mention(r, lang) if kind < 0.42 else [_decoy(r, lang)] if kind < 0.62 else [lang.sentence()]
            for part in parts:
                if isinstance(part, tuple):
                    truth.add((part[0], len(text), len(text) + len(part[1])))
                    text += part[1]
                else:
                    text += part
            text += r.choice([" ", " ", "\n", "\r\n", "\n\n"])
        yield text, truth
