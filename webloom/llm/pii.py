"""Problem 9: personal information in free text.

Method: candidate gradient boosting.  Generators of high recall propose overlapping spans for each kind; boosted trees
judge them by their format and context; spans whose calibrated probability reaches their kind's threshold are kept, the likeliest
first where they overlap, and replaced by typed placeholders.

No list of names is used, only closed-class words, titles and labels.  Whether capitalised words are a name shows in their form, in what stands around them, and in the
corpus: how often each word is written in lower case there (``WordCase``, a sketch of fixed size).  The trees are trained on
labelled sentences made up here from random syllables (``pii_training``), ``TRAINING_TEXTS`` of them, a fixed number; calibration and
thresholds come from further ones held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.boosting import BoostedTrees, calibration
from webloom.llm.sketch import counted, level

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
TRAINING_TEXTS, HELD_OUT_TEXTS = 6000, 2000
RECALL_WEIGHT = 2  # a mention left in counts for more than a placeholder too many; thresholds maximise F with this weight
CASE_CELLS = 1 << 21  # counters of each of two hashes for lower case, and as many for capitals: 8 MB of levels

# Closed-class words that begin sentences, words that stand before names and places.
CLOSED = set(
    "a an the this that these those some any each every another no our your his her their its my we you he she it they i what which who when where while if because unless although before after until since during under over near across into with without "
    "behind between around from for of in on at by to and or but not so then there here most many both all one two der die das dem den ein eine einen jede jeder jedes keine kein diese dieser dieses unsere unser ihre ihr seine mein meine wir sie es er und oder "
    "aber wenn wo weil da als mit ohne nach vor bei aus zum zur im am le la les un une des ce cette ces chaque notre votre leur son sa il elle nous vous et ou mais où quand si dans avec sans sur sous pour par el los las una este esta cada nuestra nuestro su "
    "y o pero cuando donde con sin sobre para por os um uma não nosso nossa seu sua e mas quando onde em com sem i w z na do od dla yesterday today tomorrow gestern heute ayer hoy hier aujourd ontem hoje wczoraj".split()
)
TITLES = set("mr mrs ms miss dr prof herr frau sir madam mme mlle señor señora sr sra pan pani dear liebe lieber hola cher chère".split())
_UPPER = "".join(chr(c) for c in range(0x41, 0x530) if chr(c).isupper())
_U, _L = f"[{_UPPER}]", r"[^\W\d_]"

_DOT = r"(?:\.| ?[\[({] ?(?:dot|punkt|point|punto|ponto|kropka) ?[\])}] ?| (?:dot|punkt) )"
_LOCAL = r"[\w](?:[\w.+-]{0,63}[\w])?|[\w]"
_PLAIN_EMAIL = re.compile(rf"(?<![\w.+@/-])(?:{_LOCAL})(?:@|＠|&#64;|%40)[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_HIDDEN_EMAIL = re.compile(rf"(?<![\w.+@/-])(?:{_LOCAL})(?: ?[\[({{<] ?(?:at|a|ät|arroba|małpa) ?[\])}}>] ?| ?@ ?| at (?=\w+ dot ))[^\W_](?:[\w-]*[^\W_])?(?:{_DOT}[^\W_](?:[\w-]*[^\W_])?)+", re.I)
_EMAIL_SIGN = re.compile(r"[@＠]|&#64;|%40|[\[({<] ?(?:[Aa][Tt]|[aä]|[Aa]rroba|małpa) ?[\])}>]| [Aa][Tt] (?=\w+ [Dd][Oo][Tt] )")
_EXTENSION = r"(?:,? ?(?:ext\.?|x|Durchwahl|Dw\.) ?\d{1,5})?"
_NUMBERS = [
    ("phone", re.compile(rf"(?<![\w.+/,@-])(?:\+ ?|\()?\d+(?:(?:\) ?|\)-| ?\(|[ .\-/])\d+)*{_EXTENSION}(?!\w)", re.I)),
    ("id_number", re.compile(r"(?<![\w.+/@-])(?:([A-Z]{1,3} ?\d{2}(?: ?\d{2}){2} ?[A-Z])|([A-Z]{1,2}\d{6,9})|(\d{7,9}-?[A-Z])|(\d{3}-\d{2}-\d{4})|(\d{6}[-+]\d{4})|([12] \d{2} \d{2} \w{2} \d{3} \d{3}(?: \d{2})?)|(\d{2} \d{3} \d{3} \d{3})|(\d{3}[. ]\d{3}[. ]\d{3}-?\d{2})|(\d{8,12}))(?![\w-])", re.I)),
]
_CAP = rf"(?:{_U}{_L}*(?:['’]{_L}+)?)"
_STREET = r"(?i:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Boulevard|Blvd\.?|Drive|Dr\.|Court|Ct\.?|Place|Square|Terrace|Way|Close|Crescent|Row|Walk|Highway|Parkway)"
_UNIT = r"(?:(?i:Unit|Apt\.?|Apartment|Flat|Suite|Room|Floor|Wohnung|Appt\.?|Piso|No\.) ?#?\d+ ?[A-Z]?,? )"
_TAIL = rf"(?:,? (?:\d{{2}}-?\d{{3}} |\d{{4,5}} |[A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}} )?{_CAP}(?!\w)(?:[ -]{_CAP}(?!\w)){{0,2}}(?:,? [A-Z]{{2}} \d{{5}}| [A-Z]{{1,2}}\d[\dA-Z]? ?\d[A-Z]{{2}}| \d{{5}})?)?"
_ADDRESSES = [
    re.compile(rf"(?<![\w/-]){p}{_TAIL}")
    for p in (
        rf"{_UNIT}?\d{{1,5}} ?[A-Z]?,? (?:[NSEW]\.? )?(?:{_CAP} ){{1,3}}{_STREET}(?!\w)",
        rf"{_UNIT}?(?:{_CAP} ){{1,2}}{_STREET} \d{{1,5}}[A-Z]?(?!\w)",
        rf"\d{{1,4}}(?: ?(?i:bis|ter|quater|[A-D]))?,? (?i:rue|avenue|av\.|boulevard|bd\.?|place|chemin|allée|impasse|quai|route) (?i:de la |de l['’]|des |du |de )?{_CAP}(?:[ -]{_CAP}){{0,2}}",
        rf"(?:{_CAP}[ -])?{_U}{_L}*(?i:str\.|straße|strasse|weg|allee|platz|gasse|ring|damm|ufer|chaussee) \d{{1,4}}[a-z]?(?!\w)",
        rf"(?:Am|AM|An der|Auf dem|Im|Zum|Zur|Unter den|In der) {_CAP}(?: {_CAP})? \d{{1,4}}[a-z]?(?=, \d{{5}})",
        rf"(?i:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Camino|Carrer|Rua|Travessa|Largo|Via|Viale|Piazza|Corso) (?:de |del |de la |da |dos |di )?{_CAP}(?: {_CAP})?,? (?:n\.?º? ?)?\d{{1,4}}(?:, ?\d{{1,2}}\.?[ºª°](?: ?[A-Z])?)?",
        rf"(?i:ul\.|al\.|pl\.|os\.|ulica|ул\.|улица|пр\.|просп\.) ?{_CAP}(?: {_CAP})?,? (?:д\. ?)?\d{{1,4}}[A-Za-z]?(?:[/ ]m?\.? ?\d{{1,4}})?",
        r"(?i:P\.? ?O\.? ?Box|Postfach|Apartado|Boîte postale|BP|Caixa Postal|Skrytka pocztowa) \d{1,6}",
    )
]
# Address patterns are tried at numbers only, with a capital or a street word behind them, or a capitalised or shortened word before.
_DIGITS, _LONG_NUMBER = re.compile(r"\d+"), re.compile(r"\d(?:[ ./()-]{0,2}\d){5}")
_STREET_AFTER = re.compile(rf" ?(?:[A-Za-z]|bis|ter|quater)?,? (?:{_U}|rue|av|bd|bou|pl|ch|al|imp|qu|ro)")
_PARTICLE = r"(?:de la|de los|van der|van den|von der|de|di|da|del|della|van|von|zu|le|la|dos|bin|al|af|DE|DI|VAN|VON|DA|y)"
_WORD = rf"{_U}{_L}*(?:['’-]{_L}+)*"
_TOKEN = rf"(?:{_U}\.(?:-{_U}\.)?|{_WORD})"
_CHAIN = re.compile(rf"(?<![\w@.+/'’-]){_TOKEN}(?:(?:(?<=\.) ?|,? )(?:{_PARTICLE} )?{_TOKEN})+(?![\w@])")
_PIECE, _PARTICLE_BEFORE = re.compile(rf"(?:{_PARTICLE} (?={_U}))?{_TOKEN}"), re.compile(rf"(?<!\w){_PARTICLE} $")

_ID_LABEL = re.compile(r"(?:passport|passnummer|national insurance|social security|tax(?:payer)? id|\bssn\b|\bnin\b|\bni\b|\bid\b|identity|identification|ausweis|personal|steuer|sozialversicherung|\bdni\b|\bnie\b|\bnif\b|\bcpf\b|\bpesel\b|pasaporte|passeport|sécurité sociale|паспорт|инн|снилс|personnummer|insurance|fiscal)[\w .:#/°º-]{0,14}(?:\bn(?:o|r|um|umber|ummer|º|°)\.?[ :]{0,3})?[ :#(]{0,3}$", re.I)
_PHONE_LABEL = re.compile(r"(?:phone|tel(?:efon|éfono|efone|éphone|\.)?|call|ring|dial|mobile|mobil|cell|fax|joignable au|answers on|llama al|handy|numer|тел\.?|ligue|appel\w*|hotline|whatsapp|contact|reach\w*)[\w .:]{0,12}[:. ;]{0,3}$", re.I)
_NUMBER_LABEL = re.compile(r"(?:order|lot|batch|ean|isbn|issn|position|built|run|version|v\.|invoice|ref(?:erence)?|part|model|serial|sku|item|priced|price|room|level|row|page|score|tracking|article|art\.|bestell\w*|charge|modell|commande|pedido|chapter|ticket|track|no|nr)[\w .:#-]{0,8}$", re.I)
_ADDRESS_LABEL = re.compile(r"(?:address|anschrift|adresse|dirección|endereço|adres|адрес|visit us|returns? go to|deliver\w* to|pick-?up from|lives at|located at|live at|ship to|send to|come to|meet at|office)[\w .:]{0,10}[:,. ]{0,3}(?:[^\n]{0,40}, )?$", re.I)
_NAME_LABEL = re.compile(r"(?:\b(?:name|nom|nombre|nome|nazwisko|имя|author|autor(?:in)?|автор|applicant|client|customer|kund(?:e|in)|ansprechpartner(?:in)?|contact|kontakt|attn|attention|signed|sincerely|regards|manager|director|colleague|doctor|nurse|teacher|dear|liebe[r]?|cher|chère|hola|estimad[oa]|car[oa]|szanown[ya]|mr|mrs|ms|miss|dr|prof|herr|frau|sir|madam|mme|mlle|señora?|sra?|pan|pani)\.?:?|\b(?:by|von|par|por|przez|met|wrote|write to|belongs to|ask for|of)) ?$", re.I)
_PLACE_BEFORE = re.compile(r"(?<!\w)(?:in|from|of|near|at|to|aus|en|de|em|w|z|à|around|towards|through|across|behind|into|and|und|&) $", re.I)
# Words that end the names of places and bodies, and words that stand before numbers.
BODIES = set("museum hotel university college school institute company corporation group bank church hospital theatre theater library station airport park bridge harbour road street lane avenue square limited ltd inc gmbh ag sa team club society association festival award prize edition policy " "id ean isbn order lot batch invoice ref reference position version page model serial sku item part article tracking ticket room row score chapter run price".split())
_NEXT_WORD, _LETTERS, _FIRST_INITIAL, _LAST_INITIAL = re.compile(rf" ?({_L}+)"), re.compile(rf"{_L}+"), re.compile(rf"{_U}\."), re.compile(rf"(?<!\w){_U}\.?$")
_FILE_END = re.compile(r"\.(?:png|jpe?g|gif|svg|webp|css|js|json|html?|pdf|zip|txt|md|ico)$", re.I)
_UNIT_AFTER = re.compile(r"\s*[x×%€$]|,\d|-\d|:\d")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    features: tuple[int, ...]


_ALONE = re.compile(r"(?<![\w@.+/-])[^\W\d_]+(?![\w@])")


class WordCase:
    """How often words are written in lower case, of all their places; counted over a corpus, 16 steps.

    Two hashes a word; the lesser count of the two holds, so that another word in one counter does no harm.
    """

    def __init__(self, levels: np.ndarray):
        self.levels, self.known = levels, {}

    @staticmethod
    def count(texts: Iterable[str], counters: np.ndarray) -> None:
        words: Counter[str] = Counter()

        def flush() -> None:
            for w, n in words.items():
                for cell in _cells(w):
                    counters[cell] += n
            words.clear()

        for text in texts:
            words.update(_ALONE.findall(text))
            if len(words) > 500_000:
                flush()
        flush()

    @classmethod
    def of(cls, texts: Iterable[str]) -> WordCase:
        counters = np.zeros(4 * CASE_CELLS, dtype=np.uint32)
        cls.count(texts, counters)
        return cls(case_levels(counters))

    def _of(self, word: str) -> tuple[int, int]:
        known = self.known.get(word)
        if known is None:
            if len(self.known) > 500_000:
                self.known.clear()
            low, high = (int(min(self.levels[c] for c in _cells(w))) for w in (word.lower(), word.capitalize()))
            small, large = (2 ** ((x - 1) / 2) if x else 0.0 for x in (low, high))
            known = self.known[word] = int(np.ceil(15 * small / (small + large))) if small else 0, high
        return known

    def __getitem__(self, word: str) -> int:
        """0 of a word that is never written in lower case, up to 15 of one that always is."""
        return self._of(word)[0]

    def rank(self, word: str) -> int:
        """The level of the word's count with a capital."""
        return self._of(word)[1]


def case_levels(counts: np.ndarray) -> np.ndarray:
    """One more than ``sketch.level``, so that a count of 1 isn't one of 0."""
    return np.where(counts > 0, level(counts) + 1, 0).astype(np.uint8)


def _cells(word: str) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_64_intdigest(word.lower())
    base = 0 if word[0].islower() else 2 * CASE_CELLS
    return base + h % CASE_CELLS, base + CASE_CELLS + (h >> 32) % CASE_CELLS


def _before(text: str, start: int) -> int:
    """What stands before: the text's start, a new line, a sentence's end, other signs, a small letter, a capital, a digit."""
    i = start - 1
    while i >= 0 and text[i] == " ":
        i -= 1
    if i < 0:
        return 0
    c = text[i]
    if c.isspace():
        return 1
    if c.isalpha():
        return 6 if c.islower() else 7
    return 2 if c in ".!?…" else 3 if c in ",;" else 4 if c == ":" else 5 if c in "—–-•*|>" else 8 if c.isdigit() else 9 if c in "([\"'“„«" else 10


def _after(text: str, end: int) -> int:
    if end >= len(text):
        return 0
    c = text[end]
    if c in ".!?":
        return 1 if end + 1 == len(text) or text[end + 1].isspace() else 2
    if c in ",;:":
        return 3 if c == "," else 4 if c == ";" else 5
    if c in "\n\r":
        return 6
    if c == " ":
        d = text[end + 1 : end + 2]
        return 7 if not d else 8 if d.islower() else 9 if d.isupper() else 10 if d.isdigit() else 11 if d in "(<[" else 12 if d in "—–-|" else 13
    return 14 if c == "@" else 15 if c in ")]\"'”“»>" else 16



def _number_features(kind: int, form: int, text: str, start: int, end: int) -> tuple[int, ...]:
    span, before = text[start:end], text[max(0, start - 48) : start]
    runs = re.findall(r"\d+", span)
    digits = sum(map(len, runs))
    return (
        kind, form, min(digits, 31), min(len(runs), 15), min(len(runs[0]), 15), min(len(runs[-1]), 15), bool(_ID_LABEL.search(before)), bool(_PHONE_LABEL.search(before)), bool(_NUMBER_LABEL.search(before)), span[0] == "+", span[0] == "(", span[0] == "0",
        span.count(" "), span.count("."), span.count("/"), span.count("-"), span[0].isalpha(), span[-1].isalpha(), bool(re.match(r"(?:19|20)\d\d[-/.]\d\d", span)), before[-1:] in ("$", "£", "€", "¥", "#"), bool(_UNIT_AFTER.match(text, end)), _after(text, end), _before(text, start), "ext" in span.lower(), max(map(len, runs)), 0, 0, 0, 0, 0, 0, 0,
    )


def _other_features(kind: int, form: int, text: str, start: int, end: int) -> tuple[int, ...]:
    span = text[start:end]
    digits = re.findall(r"\d+", span)
    before = text[max(0, start - 64) : start]
    return (
        kind, form, min(len(span) // 4, 31), min(len(digits), 15), bool(_ADDRESS_LABEL.search(before)) if kind == 3 else 0, bool(_PLACE_BEFORE.search(before)), _before(text, start), _after(text, end), bool(_FILE_END.search(span)), bool(re.search(r"[@＠] ?\d", span)), span.count("."),
        bool(re.search(r"https?://\S*$|\w[/?&=]\S*$", before)), any(len(d) in (4, 5) for d in digits), span.count(","), bool(re.search(r"[\])}] ?\w", span)), span.isupper(), span.count(" "), min(len(re.split(r"\W", span)[-1]), 15), before[-1:] == "/", before[-1:] == "@", 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0,
    )


def _name_features(text: str, start: int, end: int, pieces: list[tuple[int, int]], first: int, last: int, prior: str, case: WordCase) -> tuple[int, ...]:
    span = text[start:end]
    words = _LETTERS.findall(span)
    before = text[max(0, start - 24) : start]
    whole = [w for w in words if len(w) > 1 and w[0].isupper()]
    steps = [case[w] for w in whole]
    ranks = [case.rank(w) for w in whole]
    lower = [w.lower() in CLOSED or w.lower() in TITLES for w in words if w[0].isupper()]
    following = text[slice(*pieces[last + 1])] if last + 1 < len(pieces) else ""
    beside = (prior.lower() in CLOSED, case[prior] if prior else 0, max(0, min(16 + case.rank(prior) - ranks[0], 31)) if prior and ranks else 16, words[-1].lower() in BODIES, 2 * (following.lower() in BODIES) + (following.lower() in CLOSED), case[following] if following else 0)
    return (
        4, max(0, min(16 + ranks[0] - ranks[-1], 31)) if ranks else 16, min(last - first, 7), min(first, 7), min(len(pieces) - 1 - last, 7), steps[0] if steps else 0, steps[-1] if steps else 0, max(steps, default=0), lower[0], lower[-1], any(lower), "," in span, bool(_FIRST_INITIAL.match(span)), bool(_LAST_INITIAL.search(span)),
        "." in span, any(w[0].islower() for w in words), span.isupper(), any(len(w) > 1 and w.isupper() for w in words), bool(_NAME_LABEL.search(before)), bool(_PLACE_BEFORE.search(before)), _before(text, start), _after(text, end), min(len(words[0]), 15), min(len(words[-1]), 15), "-" in span, case[m.group(1)] if (m := _NEXT_WORD.match(text, end)) else 0, *beside,
    )


def candidates(text: str, case: WordCase) -> list[Span]:
    """All spans that the generators propose, overlapping ones included."""
    out: list[Span] = []
    taken: set[tuple[int, int, int]] = set()
    for sign in _EMAIL_SIGN.finditer(text):
        low, high = max(0, sign.start() - 80), min(len(text), sign.end() + 120)
        for form, pattern in enumerate((_PLAIN_EMAIL, _HIDDEN_EMAIL)):
            for m in pattern.finditer(text, low, high):
                if m.start() <= sign.start() < m.end() and (key := (form, *m.span())) not in taken:
                    taken.add(key)
                    out.append(Span("email", *m.span(), _other_features(0, form, text, *m.span())))
    if _LONG_NUMBER.search(text):
        for k, (kind, pattern) in enumerate(_NUMBERS, 1):
            for m in pattern.finditer(text):
                if m.end() - m.start() >= 7 and (k == 2 or sum(map(str.isdigit, m.group(0))) >= 7):
                    out.append(Span(kind, *m.span(), _number_features(k, m.lastindex or 0, text, *m.span())))
    long, at = sorted((s.start, s.end) for s in out if s.kind == "phone"), 0
    for sign in _DIGITS.finditer(text):
        start, end = sign.span()
        while at < len(long) and long[at][1] <= start:
            at += 1
        if at < len(long) and long[at][0] <= start:
            continue
        if not _STREET_AFTER.match(text, end):
            word = text[max(0, start - 24) : start].rstrip(" #/,").rpartition(" ")[2]
            if not word or not (word[0].isupper() or word[-1] in ".ºo"):
                continue
        low, high = max(0, start - 60), min(len(text), end + 100)
        for form, pattern in enumerate(_ADDRESSES, 10):
            for m in pattern.finditer(text, low, high):
                if m.start() <= start < m.end() and (key := (form, *m.span())) not in taken:
                    taken.add(key)
                    out.append(Span("address", *m.span(), _other_features(3, form, text, *m.span())))
    for chain in _CHAIN.finditer(text):
        pieces = [m.span() for m in _PIECE.finditer(text, *chain.span())]
        if "," in chain.group(0) and (m := _PARTICLE_BEFORE.search(text[max(0, chain.start() - 8) : chain.start()])):
            pieces[0] = (pieces[0][0] - len(m.group(0)), pieces[0][1])
        prior = ""
        while pieces and (text[slice(*pieces[0])].lower() in CLOSED or text[slice(*pieces[0])].rstrip(".").lower() in TITLES):  # they begin no name
            prior = text[slice(*pieces.pop(0))]
        for i in range(len(pieces)):
            for j in range(i + 1, min(i + 4, len(pieces))):
                start, end = pieces[i][0], pieces[j][1]
                if text.count(",", start, end) < 2:
                    out.append(Span("name", start, end, _name_features(text, start, end, pieces, i, j, text[slice(*pieces[i - 1])] if i else prior, case)))
    return out


class Redactor:
    """A trained model: trees, and for each kind calibration and threshold."""

    def __init__(self, trees: BoostedTrees, curves: dict[str, tuple[float, float]], thresholds: dict[str, float]):
        self.trees, self.curves, self.thresholds = trees, curves, thresholds

    def found(self, texts: Sequence[str], case: WordCase | None = None) -> list[list[Span]]:
        """The selected spans of each text, by start; none overlap.  Without ``case`` the texts themselves are the corpus."""
        case = case or WordCase.of(texts)
        proposed = [candidates(t, case) if t else [] for t in texts]
        flat = [s for spans in proposed for s in spans]
        if not flat:
            return [[] for _ in texts]
        margin = self.trees.margin(np.array([s.features for s in flat], dtype=np.int64))
        kinds = np.array([KINDS.index(s.kind) for s in flat])
        a, b, cut = (np.array([x[k] for k in KINDS]) for x in ({k: c[0] for k, c in self.curves.items()}, {k: c[1] for k, c in self.curves.items()}, self.thresholds))
        p = 1 / (1 + np.exp(-(a[kinds] * margin + b[kinds])))
        keep = (p >= cut[kinds]).tolist()
        p = p.tolist()
        out, i = [], 0
        for spans in proposed:
            scored = []
            for s in spans:
                if keep[i]:
                    scored.append((-p[i], s.start, -s.end, s))
                i += 1
            taken: list[Span] = []
            for _, _, _, s in sorted(scored, key=lambda x: x[:3]):
                if all(s.end <= t.start or s.start >= t.end for t in taken):
                    taken.append(s)
            out.append(sorted(taken, key=lambda s: s.start))
        return out

    def redact(self, text: str, spans: Sequence[Span]) -> str:
        out, at = [], 0
        for s in spans:
            out += [text[at : s.start], PLACEHOLDERS[s.kind]]
            at = s.end
        return "".join([*out, text[at:]])


def _labelled(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    from webloom.llm.pii_training import labelled_texts

    made = list(labelled_texts(n, seed))
    # A third of the texts is judged as if nothing were known of the corpus.
    full, none = WordCase.of(t for t, _ in made), WordCase(np.zeros(4 * CASE_CELLS, dtype=np.uint8))
    x, y, kinds = [], [], []
    for i, (text, truth) in enumerate(made):
        spans = {(kind, start, end if kind == "name" else 0) for kind, start, end in truth}  # elsewhere the start tells
        for s in candidates(text, none if i % 3 == 0 else full):
            x.append(s.features)
            y.append((s.kind, s.start, s.end if s.kind == "name" else 0) in spans)
            kinds.append(KINDS.index(s.kind))
    return np.array(x, dtype=np.int64), np.array(y, dtype=float), np.array(kinds)


@lru_cache(1)
def trained(texts: int = TRAINING_TEXTS, held_out: int = HELD_OUT_TEXTS, seed: int = 7) -> Redactor:
    """The model, trained in a few seconds; the same for the same arguments."""
    x, y, _ = _labelled(texts, seed)
    trees = BoostedTrees().fit(x, y)
    x, y, kinds = _labelled(held_out, seed + 1)
    margin, curves, thresholds = trees.margin(x), {}, {}
    for k, kind in enumerate(KINDS):
        m, t = margin[kinds == k], y[kinds == k]
        a, b = curves[kind] = calibration(m, t)
        p = 1 / (1 + np.exp(-(a * m + b)))
        cuts = np.linspace(0.1, 0.8, 29)
        score = [(1 + RECALL_WEIGHT**2) * ((p >= c) & (t > 0)).sum() / max(1, (p >= c).sum() + RECALL_WEIGHT**2 * t.sum()) for c in cuts]
        best = np.flatnonzero(np.array(score) >= max(score) - 1e-9)
        thresholds[kind] = float(cuts[best[len(best) // 2]])
    return Redactor(trees, curves, thresholds)


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def word_case(df: DataFrame, text_col: str = "text"):
    """``WordCase`` levels of a whole corpus, sent to the executors: ``4 * CASE_CELLS`` bytes for a corpus of any size."""

    def count(batches: Iterator[pa.RecordBatch], counters: np.ndarray) -> None:
        WordCase.count((t for batch in batches for t in batch.column(0).to_pylist()), counters)

    texts = df.select(F.col(text_col).cast("string").alias("text")).where(F.col("text") != "")
    return df.sparkSession.sparkContext.broadcast(counted(texts, count, 4 * CASE_CELLS, case_levels))


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Redactor | None = None) -> DataFrame:
    """``(doc_id, kind, start_pos, end_pos, value)``: each mention; positions count characters from 1, the end included.

    NULL and empty texts have none; repeated rows give their mentions repeatedly; texts are searched whole; an empty
    table gives an empty result.  Words are counted over all texts first; the model, some hundred kilobytes, travels with the tasks.
    """
    model, levels = model or trained(), word_case(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case = WordCase(levels.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = [(doc, s.kind, s.start + 1, s.end, t[s.start : s.end]) for doc, t, spans in zip(batch.column(0).to_pylist(), texts, model.found(texts, case), strict=True) for s in spans]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "kind", "start_pos", "end_pos", "value"])

    return _texts(df, id_col, text_col).where(F.col("text") != "").mapInArrow(run, "doc_id bigint, kind string, start_pos int, end_pos int, value string")


def redacted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Redactor | None = None) -> DataFrame:
    """``(doc_id, clean_text, n_found)``: every row with its mentions replaced by typed placeholders; NULL stays NULL."""
    model, levels = model or trained(), word_case(df, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case = WordCase(levels.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = model.found([t or "" for t in texts], case)
            clean = [t and model.redact(t, spans) for t, spans in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array([len(s) for s in found], pa.int64())], names=["doc_id", "clean_text", "n_found"])

    return _texts(df, id_col, text_col).mapInArrow(run, "doc_id bigint, clean_text string, n_found bigint")
