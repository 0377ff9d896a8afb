"""Personal items in free text: found, and replaced by typed placeholders.

A semi-Markov conditional random field over whole spans. Rules propose candidate segments (an
address or a name is one candidate, not a run of tagged tokens); features of the whole span
and of its surroundings score each of them as its type, and pairs of types score segments that
stand directly beside each other; dynamic programming over the candidates picks the set of
segments that don't overlap and has the highest total, so boundaries and types are chosen
jointly. The weights are those of the conditional likelihood of labelled sentences
(``pii_examples``, ``SENTENCES`` of them, whatever the corpus), fitted once on the driver in
some seconds with sums over all segmentations by the forward and backward recursions.

Defined cases: a null text has no items and stays null, an empty one stays empty; texts are
read whole, in one piece; items have no greatest length: a name may have any number of
initials, particles and given names and up to four other words, and one of more than
``LONG_NAME`` tokens must begin or end within two tokens of where its run of such words does;
an item is written out exactly as it stands, inner blanks and line breaks included; equal
items of one document are one row of ``find``; repeated rows are read each on its own;
everything outside the items is left unchanged by ``mask``.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.pii_examples import SURNAME_ENDS, Sentences
from tallyfold.llm.similarity import LEGAL_FORMS

KINDS = ("email", "phone", "id_number", "address", "name")
SENTENCES, EPOCHS = 9_000, 5
#: Tokens of a name up to which every part of a run is a candidate.
LONG_NAME = 12
#: Segments with at most so many signs between them, none a letter or figure, are beside each other.
BESIDE = 4

# Titles, particles of names, words that open a signature or name a person, and kinds of streets.
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "herr", "frau", "hra", "rva", "herra", "rouva", "fru", "mme", "mlle", "monsieur", "madame")
PARTICLES = ("de", "la", "van", "von", "der", "den", "du", "le", "af", "av", "zu", "di", "da", "ten", "el")
OPENERS = ("by", "attn", "contact", "sgd", "for", "from", "neighbour", "driver", "sheets", "regards", "cordialement", "grüßen", "grüssen", "hälsningar", "terveisin", "durch", "vertretung", "ansprechpartner", "sijaisena", "on", "allekirjoitti", "hyväksyjä", "kontakta", "chaufför", "contacter", "par", "pour", "av", "och", "of", "to", "and", "was", "ask", "authorised", "call", "per",
           "dear", "hello", "hi", "ring", "wishes", "sincerely", "thanks", "signed", "written", "reviewed", "recorded", "prepared", "approved", "behalf", "sender", "with", "von", "unterschrieben", "freigegeben", "kontakt", "grüße", "vertritt",
           "allekirjoittanut", "hyväksynyt", "tuuraa", "antaa", "kuski", "föraren", "fråga", "godkänd", "joindre", "signé", "vu", "et", "und", "ja", "moi")
STREETS_EN = "road|rd|street|st|lane|ln|way|close|yard|ave|avenue|court|drive|place|square|terrace|row|hill|gardens"
STREETS_ONE = (
    "straße|strasse|str|weg|gasse|platz|allee|ufer|damm|gatan|gata|vägen|väg|stigen|stig|gränd|gränden|torg|torget|plan|planen|backen|"
    "raitti|tie|katu|polku|kuja|kaari|ranta|puistikko|rinne"
)
STREETS_FR = "rue|avenue|av|allée|chemin|quai|place|boulevard|bd|impasse|route|cours|passage|sentier|square"

_OPEN = frozenset(OPENERS) | frozenset(TITLES)
_BLANKS = frozenset((" ", "  ", "   ", "\xa0", " \xa0", "\xa0 "))



def _both(pattern: str) -> str:
    """A pattern in which accents may also be written apart from their letters."""
    return "".join(c if (d := unicodedata.normalize("NFD", c)) == c else f"(?:{c}|{d})" for c in pattern)


_W = r"(?:[^\W\d_]|[\u0300-\u036f])"  # a letter, or the accent of one written apart
_NT = rf"{_W}+(?:[-'’](?![sS]\b){_W}+)*"
_TOKEN = re.compile(rf"(?<!\w)(?:{_W}\.(?=[\s,;.)/]|\Z)|{_NT})")
_TOKEN_PLAIN = re.compile(_TOKEN.pattern.replace(_W, r"[^\W\d_]"))  # the same, faster, for texts without accents written apart
_ACCENT = re.compile(r"[\u0300-\u036f]")
_GAP = re.compile(r"(?:[ \xa0]{1,3}|, | ?\r?\n ?)\Z")

_EMAIL = re.compile(
    r"\w(?:[\w\u0300-\u036f.+-]*[\w\u0300-\u036f])?(?:\s?@\s?|\s?[(\[{]\s?(?:a\u0308|[aä])t\s?[)\]}]\s?|\sat\s)"
    r"[\w\u0300-\u036f-]+(?:(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)[\w\u0300-\u036f-]+)*(?:\.|\s?[(\[]dot[)\]]\s?|\sdot\s)[^\W\d_]{2,}(?![\w@-])",
    re.I,
)
_AT = re.compile(r"@|[(\[{]\s?(?:[aA]\u0308|[aäAÄ])[tT]\s?[)\]}]|\s[aA][tT]\s")
_PHONE = re.compile(r"(?<![\w.,/+-])(?=[+(\d][\d ()+./\-\xa0\n–]{4,}\d)\+?\(?\d+\)?(?:(?:[ \xa0]?[/.\-()–][ \xa0]?|[ \xa0\n])\(?\d+\)?|(?<=\))\d+\)?)*(?!\w)")
_DECIMAL, _DOTTED = re.compile(r"\d\.\d{2}(?=[ \n]|\Z)"), re.compile(r"\+?[\d. ]*\d{2}\.\d{2}\.\d{2}\Z")
_DATE = re.compile(r"(?:\d{1,2}[./-]\d{1,2}[./-](?:19|20)\d\d|(?:19|20)\d\d-\d\d-\d\d)\Z")
# Forms of identity numbers and passports; each is looked for from its first digit on, the two letters before that of the last two kinds after.
_ID_FORMS = (
    r"(?<![\w/-]\d)\d{2}[- ]\d{2}[- ]\d{4}",
    r"(?<![\w/-]\d)\d{5}[-+Aa]\d{3}[0-9A-Za-z]",
    r"(?<![\w/-]\d)(?<=[12])(?: \d{2} \d{2} \d{2} \d{3} \d{3} \d{2}|\d{14})",
    r"(?<![\w/-]\d)\d{7}-\d{4}",
    r"(?:(?<=[A-Za-z]{2}\d)|(?<=[A-Za-z]{2} \d))\d ?\d{2} ?\d{2} ?[A-Da-d]",
    r"(?<=[A-Za-z]{2}\d)\d{6}",
)
_IDS = re.compile(rf"\d(?=[-\dAa +]{{6}})(?:{'|'.join(f'({x})' for x in _ID_FORMS)})(?![\w/-])")
_WITH_LETTERS = 5

_WORD = r"[^\W\d_][\w\u0300-\u036f'’-]*"
_TAIL_CODE = rf"(?:,[ \xa0]{{1,2}}|[ \xa0]?\r?\n[ \xa0]?)(?:\d{{5}}|\d{{3}} \d{{2}})[ \xa0]{_WORD}"
_TAIL_EN = rf"(?:,[ \xa0]{{1,2}}|[ \xa0]?\r?\n[ \xa0]?){_WORD}(?:[ \xa0]{_WORD})?[ \xa0][A-Z]{{1,2}}\d{{1,2}}[A-Z]? \d[A-Z]{{2}}(?!\w)"
_FLAT = r"(?:,?[ ](?:as\.|lgh|apt\.?|suite|unit|flat|whg\.?|wohnung|bât\.?|app\.?|rappu|tr\.?)[ ]?\w{1,4}(?!\w))?"
_UNIT = r"\d{1,4}(?:[-–/]\d{1,4})?(?:[ ]?[A-Za-z](?![\w'’])(?:[ ]\d{1,3}(?!\w))?)?" + _FLAT
_HINTS = {
    "en": re.compile(rf"\d[a-z]?[ ]{{1,2}}(?:{_WORD}[ ]{{1,2}}){{1,3}}(?:{STREETS_EN})(?!\w)", re.I),
    "one": re.compile(r" (?:(?<=[\w\u0308] )|(?<=[\w\u0308]\. )) ?(?=\d)"),  # after a word that ends like a street
    # beginnings that say no more than the next pattern needs, so that the search is quick
    "am": re.compile(r"[AaIiZzUu](?<!\w[AaIiZzUu])(?:[mM]|[nN] [dD][eE][rRnN]|[uU][fF] [dD][eE][rRmM]|[uU][mMrR]|[nN][tT][eE][rR] [dD][eE][nN])[ ]"),
    "fr": re.compile(rf" (?=[racqpbis])(?:{_both(STREETS_FR)})\.? ", re.I),
}
_STREET_ENDS = tuple({f for x in STREETS_ONE.split("|") for f in (x, unicodedata.normalize("NFD", x)) for f in (f, f"{f}.")})
#: Signs of a line before and after the hint that the whole of an address is looked for in.
_BACK = 1_000
_ADDRESSES = (
    ("en", re.compile(rf"(?<![\w.,-])(?:(?:Flat|Unit|Bldg|Building|Apt|Suite|Block|Floor)[ ]\w{{1,4}},[ ])?\d{{1,4}}(?:[-–]\d{{1,4}})?[a-z]?[ ]{{1,2}}(?:{_WORD}[ ]{{1,2}}){{1,3}}(?:{STREETS_EN})(?![\w/-]|[ ]\d{{3}}(?!\d)|\.\d)\.?{_FLAT}", re.I), re.compile(_TAIL_EN, re.I)),
    ("one", re.compile(rf"(?<![\w-])(?:{_WORD}[ ]{{1,2}}){{0,2}}(?:{_WORD})?(?<=\w)(?:{_both(STREETS_ONE)})\.?[ ]{{1,2}}{_UNIT}(?!\w)", re.I), re.compile(_TAIL_CODE, re.I)),
    ("am", re.compile(rf"(?<!\w)(?:Am|An der|An den|Auf der|Auf dem|Im|In der|Zum|Zur|Unter den)(?:[ ]{_WORD}){{1,2}}[ ]{{1,2}}{_UNIT}(?!\w)", re.I), re.compile(_TAIL_CODE, re.I)),
    ("fr", re.compile(rf"(?<![\w-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[A-D]))?,?[ ]{{1,2}}(?:{_both(STREETS_FR)})\.?[ ](?:(?:de la|de l['’]|du|des|de|d['’])[ ]?)?{_WORD}(?:[ ][A-ZÀ-Þ]{_WORD}){{0,2}}", re.I), re.compile(_TAIL_CODE, re.I)),
)

_NINES = {ord(c): "9" for c in "012345678"}


def _low(text: str) -> str:
    return text.lower().translate(_NINES)


_NEXT = re.compile(r"\n?\s*([^\W_]*)")


def _before(text: str, start: int, kind: str) -> tuple[list[str], int]:
    """Features of what stands before a span, and whether it begins a line."""
    before = text[max(0, start - 30) : start]
    words = before.split()
    line = int("\n" in before[len(before.rstrip()) :] or not words)
    p1 = _low(words[-1].lstrip("(<[\"'"))[-14:] if words else "^"
    p2 = _low(words[-2])[-14:] if len(words) > 1 else "^"
    if before[-1:] in ("(", "[", "<", '"') and len(before) > 1:
        p1 = before[-1] + p1
    return [f"{kind}|p1={p1}", f"{kind}|p2={p2} {p1}", f"{kind}|l={line}"], line


def _behind(text: str, end: int, kind: str) -> tuple[list[str], str]:
    """Features of what stands after a span, and the sign there."""
    stripped = text[end : end + 24].lstrip(" \t\xa0\r")
    n1 = _low(_NEXT.match(stripped).group(1)[:12])
    sign = stripped[:1] if stripped[:1] and not stripped[:1].isalnum() else ""
    return [f"{kind}|n0={sign!r}", f"{kind}|n1={n1}"], sign


def _beside(text: str, end: int, start: int) -> str | None:
    """What stands between two segments that are beside each other; None if they are not."""
    gap = text[end:start]
    if len(gap) > BESIDE or any(c.isalnum() for c in gap):
        return None
    return "n" if "\n" in gap else gap.strip() or ("b" if gap else "")


class _Classes(dict):
    """Token -> (class, code, case), found once; forgets everything when it is full."""

    def __init__(self, given: frozenset[str]) -> None:
        super().__init__()
        self.given = given

    def __missing__(self, token: str) -> tuple[str, str, str]:
        if len(self) >= 200_000:
            self.clear()
        c, code = self.of(token)
        case = "I" if c == "I" else "U" if token.isupper() and len(token) > 2 else "C" if token[0].isupper() else "l"
        self[token] = found = (c, code, case)
        return found

    def of(self, token: str) -> tuple[str, str]:
        """class: I initial, p particle, T title, L legal form, O opener, g given name, s like a surname, w other.

        code, for the search of places where a name may be: n given, or like a surname and capital, t title,
        m the M. that may be one, k other with a capital, K the same and an opener, p particle,
        P the same and an opener, o opener, x like a surname in small letters, . nothing of this.
        """
        plain = token.lower()
        low = unicodedata.normalize("NFC", plain)
        opens = plain in _OPEN
        if len(token) == 2 and token[1] == ".":
            c = "I"
        elif low in PARTICLES:
            c = "p"
        elif low in TITLES:
            c = "T"
        elif low in LEGAL_FORMS:
            c = "L"
        elif len(low) > 4 and low in OPENERS:
            c = "O"
        elif low in self.given:
            c = "g"
        else:
            last = low.rpartition("-")[2]
            c = "s" if len(last) > 4 and last.endswith(SURNAME_ENDS) else "w"
        if c == "g" or (c == "s" and token[0].isupper()):
            return c, "n"
        if c == "T":
            return c, "t"
        if token == "M.":
            return c, "m"
        if c in "wI" and token[0].isupper():
            return c, "K" if opens else "k"
        return c, "x" if c == "s" else ("P" if opens else "p") if c == "p" else "o" if opens else "."


#: A place where a name may be: a given name or one like a surname, one like a surname in small letters in the second place after an opener, a capital word after an opener with a capital or a particle behind it, a capital word after a title.
_ANCHOR = re.compile(r"n|(?<=[oKPtm][.x])x|(?<=[oKPtm])[kKm](?=[nkKpPm])|(?<=[tm])[kKm]")
_RUNS = re.compile(r"([Ipg])\1+")
_TITLE_GAP = re.compile(r"\.?[ \xa0]{1,2}|[ \xa0]?\n")


class Model:
    """Candidates and their features for a lexicon of given names, and the weights of the features."""

    def __init__(self, given: tuple[str, ...], weights: dict[str, float]) -> None:
        self.given, self.weights = frozenset(g.lower() for g in given), weights
        self.classes = _Classes(self.given)
        self.training = isinstance(weights, defaultdict)
        self.parts: dict[tuple, float] = {}
        self.left: dict[tuple[int, str], tuple[float, int]] = {}
        self.right: dict[tuple[int, str], tuple[float, str]] = {}
        self.shapes: dict[tuple, tuple[str, str, int] | None] = {}
        self.texts: dict[str, list[tuple[int, int, str]]] = {}
        most = lambda start: max([0.0, *(w for f, w in weights.items() if f.startswith(start))])
        self.most_word, self.most_inside = (0.0, 0.0) if self.training else (most("name|w="), sum(map(most, ("name|nx=", "name|nx2=", "name|pv=", "name|nxC"))))
        self.pairs = {f: w for f, w in weights.items() if f.startswith(">")}
        self.most_beside = 0.0 if self.training else 2 * max([0.0, *self.pairs.values()])
        self.most_around = {k: self._most_around(k) for k in KINDS}

    def _most_around(self, kind: str) -> float:
        """The most that what stands around a segment can add to its score."""
        most: dict[str, float] = {}
        for f, w in () if self.training else self.weights.items():
            of, _, rest = f.partition("|")
            if of == kind and (group := next((g for g in ("p1=", "p2=", "l=", "n0=", "n1=", "l0n0=", "l1n0=") if rest.startswith(g)), None)):
                most[group] = max(most.get(group, 0.0), w)
        return sum(most.values())

    def score(self, features: list[str]) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in features])

    def _candidate(self, text: str, start: int, end: int, kind: str, key: tuple, features: Callable[[], list[str]], words: list[str] = (), around: bool = True) -> Iterator[tuple]:
        """(start, end, kind, features), or with a score in place of the features when the model is fitted.

        What depends on ``key`` alone is scored once, what stands before a place and behind one
        once in each text; segments that can't reach a score with which they would ever be
        chosen are left out.
        """
        if self.training:
            out = [*features(), *words]
            if around:
                (before, line), (behind, sign) = _before(text, start, kind), _behind(text, end, kind)
                out += [*before, *behind, f"{kind}|l{line}n0={sign!r}"]
            yield start, end, kind, out
            return
        base = self.parts.get(key)
        if base is None:
            if len(self.parts) >= 200_000:
                self.parts.clear()
            base = self.parts[key] = self.score(features())
        if words:
            base += self.score(words)
        if base + (self.most_around[kind] if around else 0.0) + self.most_beside <= 0:
            return
        if around:
            left = self.left.get((start, kind))
            if left is None:
                found, line = _before(text, start, kind)
                left = self.left[start, kind] = (self.score(found), line)
            right = self.right.get((end, kind))
            if right is None:
                found, sign = _behind(text, end, kind)
                right = self.right[end, kind] = (self.score(found), sign)
            base += left[0] + right[0] + self.weights.get(f"{kind}|l{left[1]}n0={right[1]!r}", 0.0)
        if base + self.most_beside > 0:
            yield start, end, kind, base

    def candidates(self, text: str) -> list[tuple]:
        """Segments that may be items, in no order."""
        self.left, self.right = {}, {}
        return [*self._emails(text), *self._phones(text), *self._ids(text), *self._addresses(text), *self._names(text)]

    def _emails(self, text: str) -> Iterator[tuple]:
        done = 0
        for a in _AT.finditer(text):
            end = a.start() - (a.start() > 0 and text[a.start() - 1].isspace())
            s = end
            while s > done and ((c := text[s - 1]).isalnum() or c in "_.+-" or "\u0300" <= c <= "\u036f"):
                s -= 1
            while s < end and not (text[s].isalnum() or text[s] == "_"):
                s += 1
            m = _EMAIL.match(text, s) if s < end else None
            if m is None or m.end() <= a.start():
                continue
            done = m.end()
            x = m.group().lower()
            how = "plain" if re.fullmatch(r"[^\s()\[\]{}]+@[^\s()\[\]{}]+", x) else "word" if re.search(r"\sat\s", x) else "other"
            odd = int(bool(re.search(r"[._+0-9]", x.split("@")[0].split(" ")[0])))
            yield from self._candidate(text, s, done, "email", ("email", how, odd), lambda: ["email|b", f"email|{how}", f"email|{how}{odd}"], around=how == "word")  # noqa: B023

    def _phones(self, text: str) -> Iterator[tuple]:
        for m in _PHONE.finditer(text):
            run, begin = m.group(), m.start()
            if len(run) < 6 or sum(map(str.isdigit, run)) < 6:
                continue
            if run[0] == "(" and (")" not in run or run.index(")") > 6):  # the bracket around it, not one of its own
                run, begin = run[1:].partition(")")[0], begin + 1
            starts = [0, *(g.start() for g in re.finditer(r"(?<=[ \xa0])(?:\+|0|\()|(?<=\n)[+0(\d]", run))]
            groups = [(g.start(), g.end()) for g in re.finditer(r"\d+", run)]
            for o, a in enumerate(starts):
                n = 0
                for g0, g1 in groups[bisect.bisect_left(groups, (a, 0)) :]:
                    n += g1 - g0
                    if n > 15:
                        break
                    if n < 6:
                        continue
                    x = run[a:g1]
                    if x.count("\n") > 1:
                        break
                    if _DATE.match(x) or (_DECIMAL.search(x) and not _DOTTED.match(x)):
                        continue
                    sig = re.sub(r"\d+", lambda d: str(len(d.group())), x).replace("\xa0", " ").replace("\n", " ")
                    lead = x[0] if x[0] in "+0(" else "d"
                    full, first, breaks = int(g1 == len(run)), x[:3] if x[0] in "+0" else lead, "\n" in x
                    f = lambda: ["phone|b", f"phone|sig={sig}", f"phone|{lead}{n}", f"phone|full={full}", f"phone|sig={sig}{full}", f"phone|{first}|{sig}", f"phone|{first}|{n}", f"phone|g={len(sig.split())}{lead}", f"phone|o={int(o > 0)}", *([f"phone|nl{lead}"] if breaks else [])]  # noqa: B023, E731
                    yield from self._candidate(text, begin + a, begin + g1, "phone", ("phone", sig, lead, n, full, first, o > 0, breaks), f)

    def _ids(self, text: str) -> Iterator[tuple]:
        for m in _IDS.finditer(text):
            (start, end), k = m.span(), m.lastindex
            if k >= _WITH_LETTERS:
                start -= 2 + (text[start - 1] == " ")
                if start and (text[start - 1].isalnum() or text[start - 1] in "_/-"):
                    continue
            blank = " " in text[start:end]
            yield from self._candidate(text, start, end, "id_number", ("id_number", k, blank), lambda: ["id_number|b", f"id_number|f={k}", f"id_number|f={k}{blank}"])  # noqa: B023

    def _addresses(self, text: str) -> Iterator[tuple]:
        for which, head, tail in _ADDRESSES:
            done = -1
            for h in _HINTS[which].finditer(text):
                if which == "one" and not text[max(0, h.start() - 14) : h.start()].lower().endswith(_STREET_ENDS):
                    continue
                if h.end() <= done:
                    continue
                # the words of one line, and of the next for what is broken after the number
                low = max(done, text.rfind("\n", 0, h.start()) + 1, h.start() - _BACK)
                high = text.find("\n", h.end())
                high = min(len(text) if high < 0 else high, h.end() + _BACK)
                for m in head.finditer(text, low, high):
                    done = m.end()
                    yield from self._address(text, m, which, tail)

    def _names(self, text: str) -> Iterator[tuple]:
        """Runs around a place where a name may be; see the module for what they may hold."""
        token = _TOKEN if _ACCENT.search(text) else _TOKEN_PLAIN
        words = token.findall(text)
        kinds = list(map(self.classes.__getitem__, words))
        codes = "".join([k[1] for k in kinds])
        anchors = [a.start() for a in _ANCHOR.finditer(codes)]
        if not anchors:
            return
        cls, cases = "".join([k[0] for k in kinds]), "".join([k[2] for k in kinds])
        tokens = [(w, *m.span()) for w, m in zip(words, token.finditer(text))]
        n, gaps = len(tokens), {}

        def join(k: int) -> str | None:
            """How tokens k and k + 1 are joined within a name: blank, comma or line break; None if they can't be."""
            if k not in gaps:
                gap = text[tokens[k][2] : tokens[k + 1][1]]
                gaps[k] = " " if gap == " " else ("," if "," in gap else "/" if "\n" in gap else " ") if len(gap) < 5 and _GAP.match(gap) else None
            return gaps[k]

        def reach(here: int, step: int) -> tuple[int, int]:
            """(end of what is looked at in full, end of the run) from an anchor on, in one direction."""
            k, other, marks, near = here, 0, 0, here
            while 0 <= k + step < n:
                j, c = join(min(k, k + step)), cls[k + step]
                other, marks = other + (c in "ws"), marks + (j != " ")
                if j is None or c in "LOT" or other > 3 or marks > 1:
                    break
                if abs(k + step - here) >= LONG_NAME and (c in "ws" or j != " "):
                    break
                k += step
                if abs(k - here) < LONG_NAME:
                    near = k
                elif (k, step) in ends:
                    return near, ends[k, step]
            if abs(k - here) >= LONG_NAME:
                for x in range(here + step * LONG_NAME, k + step, step):
                    ends[x, step] = k
            return near, k

        seen: set[tuple[int, int]] = set()
        ends: dict[tuple[int, int], int] = {}
        for here in anchors:
            if codes[here] != "n" and tokens[here][1] - tokens[here - 1][2] > 4:
                continue
            (low, far_low), (high, far_high) = reach(here, -1), reach(here, 1)
            spans = [(i, j) for i in range(low, here + 1) for j in range(here, high + 1) if j - i < LONG_NAME]
            if far_low < low or far_high > high:
                spans += [(i, j) for i in range(far_low, min(far_low + 3, here + 1)) for j in range(max(far_high - 2, here), far_high + 1)]
            for i, j in spans:
                if (i, j) not in seen:
                    seen.add((i, j))
                    yield from self._name(text, tokens, cls, cases, join, i, j)

    def _name(self, text: str, tokens: list, cls: str, cases: str, join: Callable[[int], str | None], i: int, j: int) -> Iterator[tuple]:
        titled = 0
        if i > 0 and (cls[i - 1] == "T" or tokens[i - 1][0] == "M.") and _TITLE_GAP.fullmatch(text, tokens[i - 1][2], tokens[i][1]):
            titled = 1 if cls[i - 1] == "T" else 2  # M. may be an initial as well
        key = (cls[i : j + 1], cases[i : j + 1], "".join([join(k) for k in range(i, j)]), titled)
        known = self.shapes.get(key, 0)
        if known == 0:
            if len(self.shapes) >= 200_000:
                self.shapes.clear()
            known = self.shapes[key] = self._shape(*key)
        if known is None:
            return
        shape, case, k = known
        words = [t[0] for t in tokens[i : j + 1]]
        space = lambda k: 0 <= k < len(tokens) - 1 and text[tokens[k][2] : tokens[k + 1][1]] in _BLANKS
        after = space(j)
        nxt = cls[j + 1] if after else "-"
        legal = nxt == "L" or (after and space(j + 1) and cls[j + 2] == "L")
        prv = cls[i - 1] if space(i - 1) else "-"
        capital = after and tokens[j + 1][0][0].isupper()
        f = lambda: [*self._of_shape(shape, case, titled, k), f"name|nx={nxt}", f"name|nx2={'L' if legal else '-'}", f"name|pv={prv}", *(["name|nxC"] if capital else [])]
        other = [f"name|w={w.lower()}" for w, c in zip(words, key[0]) if c == "w"]
        yield from self._candidate(text, tokens[i][1], tokens[j][2], "name", ("name", shape, case, nxt, legal, prv, titled, k, capital), f, other)

    @staticmethod
    def _of_shape(shape: str, case: str, titled: int, k: int) -> list[str]:
        return [f"name|sh={shape}", f"name|case={case}", f"name|sh={shape}{case}", f"name|t={titled}", f"name|t={titled}k={k}"]

    def _shape(self, inner: str, cases: str, between: str, titled: int) -> tuple[str, str, int] | None:
        """(shape, case, length) of a run that may be a name; None if it can't be, or if it can't score whatever stands in it and around it."""
        if inner[-1] == "p" or inner.count("w") + inner.count("s") > 4:
            return None
        if (inner[0] == "p" and not titled) or (len(inner) == 1 and (not titled or inner == "I")):
            return None
        marks = len(between) - between.count(" ")
        if marks > 1 or (inner[-1] == "I" and "," not in between) or (marks and any(c == "I" and gap == "/" for c, gap in zip(inner, between))):
            return None
        shape = _RUNS.sub(r"\1", "".join([c + gap for c, gap in zip(inner, between + " ")]).replace(" ", ""))
        kinds = set(cases) - {"I"}
        case = "U" if kinds == {"U"} else "l" if kinds == {"l"} else "M" if len(kinds) == 3 or kinds == {"U", "C"} else "C" if cases[0] != "l" and cases[-1] != "l" else "x"
        k = min(len(inner), 5)
        if not self.training and self.score(self._of_shape(shape, case, titled, k)) + self.most_inside + inner.count("w") * self.most_word + self.most_around["name"] + self.most_beside <= 0:
            return None
        return shape, case, k

    def _address(self, text: str, m: re.Match, which: str, tail: re.Pattern) -> Iterator[tuple]:
        spans = {m.span()}
        if which == "one":  # a street's name may have fewer words than stand before its last
            words = [m.start() + w.start() for w in re.finditer(r"\S+", m.group())]
            spans |= {(w, m.end()) for w in words[:3] if not text[w].isdigit()}
        if which == "fr":
            words = [m.start() + w.end() for w in re.finditer(r"\S+", m.group())]
            spans |= {(m.start(), w) for w in words[2:]}
        if which == "en" and text[m.end() - 1] == ".":
            spans.add((m.start(), m.end() - 1))
        for s, e in spans:
            t = tail.match(text, e)
            for end in (e, t.end()) if t else (e,):
                x = text[s:end]
                words = re.findall(_WORD, text[s:e])
                case = "l" if any(w[0].islower() and len(w) > 3 for w in words) else "C"
                if which == "fr":
                    case = "C" if any(w[0].isupper() for w in words) else "l"
                number = re.search(r"\d+", x)
                tailed, dot, size, count = int(end > e), int(x[-1] == "."), min(len(number.group()), 4) if number else 0, len(words)
                sign = text[end : end + 1]
                f = lambda: [f"address|b={which}", f"address|{which}{case}", f"address|{which}t{tailed}{int(bool(t))}", f"address|{which}k={count}", f"address|len={size}", f"address|dot={dot}{sign!r}"]  # noqa: B023, E731
                named = [f"address|w={w.lower()}" for w in words[: 4 if which == "en" else 1]]
                if which != "en" and count > 1:
                    named.append(f"address|e={words[0][-5:].lower()}")
                named.append(f"address|end={words[-1].lower() if words else ''}{text[e - 1] == '.'}{text[e : e + 1] == '.'}")
                yield from self._candidate(text, s, end, "address", ("address", which, case, tailed, bool(t), count, size, dot, sign), f, named)

    def segments(self, text: str) -> list[tuple[int, int, str]]:
        """The best set of segments that don't overlap; that of a text which came before is looked up."""
        known = self.texts.get(text)
        if known is None:
            known = self._segments(text)
            if len(text) <= 4000:
                if len(self.texts) >= 10_000:
                    self.texts.clear()
                self.texts[text] = known
        return known

    def beside(self, text: str, a: tuple, b: tuple) -> float | None:
        """Weight of two segments beside each other; None if they aren't."""
        gap = _beside(text, a[1], b[0])
        return None if gap is None else self.pairs.get(f">{a[2]}>{b[2]}|{gap}", 0.0)

    def _segments(self, text: str) -> list[tuple[int, int, str]]:
        """Dynamic programming over the candidates by their ends; each follows the best that ends before it, or one beside it."""
        cands = sorted(self.candidates(text), key=lambda c: (c[1], c[0], c[2]))
        ends = [c[1] for c in cands]
        total, back = [0.0] * len(cands), [-1] * len(cands)
        top: list[int] = []  # number of the best of the first k + 1 candidates
        for k, c in enumerate(cands):
            near = bisect.bisect_right(ends, c[0])
            far = bisect.bisect_left(ends, c[0] - BESIDE)
            best, at = (total[top[far - 1]], top[far - 1]) if far and total[top[far - 1]] > 0 else (0.0, -1)
            for p in range(far, near):
                w = total[p] + (self.beside(text, cands[p], c) or 0.0)
                if w > best:
                    best, at = w, p
            total[k], back[k] = best + c[3], at
            top.append(k if not top or total[k] > total[top[-1]] else top[-1])
        out, k = [], top[-1] if top and total[top[-1]] > 0 else -1
        while k >= 0:
            out.append(cands[k][:3])
            k = back[k]
        return out[::-1]


def _log_sum(xs: list[float]) -> float:
    top = max(xs)
    return top if top == -math.inf else top + math.log(sum([math.exp(x - top) for x in xs]))


def expected(cands: list[tuple], scores: list[float], pairs: dict[tuple[int, int], float]) -> tuple[list[float], dict[tuple[int, int], float]]:
    """Probabilities of each candidate and of each pair beside each other, under the distribution over all segmentations.

    cands: (start, end, ...) by their ends; pairs: weight of candidate b after candidate a with nothing between.
    """
    n = len(cands)
    ends = [c[1] for c in cands]
    by_start = sorted(range(n), key=lambda k: cands[k][0])
    starts = [cands[k][0] for k in by_start]
    before, behind = defaultdict(list), defaultdict(list)
    for a, b in pairs:
        before[b].append(a)
        behind[a].append(b)

    def summed(own: list[float], upto: list[float], count: int, apart: list[tuple[float, float]]) -> float:
        """All that may come next to a candidate: nothing, any of ``count`` others, those beside it with their weight."""
        xs = [0.0, *([upto[count - 1]] if count else [])]
        total = _log_sum(xs)
        if not apart:
            return total
        # those beside are in the sum without their weight: take them out and put them in with it
        rest = math.exp(total) - sum(math.exp(x) for x, _ in apart)
        return math.log(max(rest, 0.0) + sum(math.exp(x + w) for x, w in apart))

    forward, upto = [0.0] * n, []
    for k in range(n):
        count = bisect.bisect_right(ends, cands[k][0])
        forward[k] = scores[k] + summed(forward, upto, count, [(forward[a], pairs[a, k]) for a in before[k]])
        upto.append(forward[k] if not upto else _log_sum([upto[-1], forward[k]]))
    whole = _log_sum([0.0, upto[-1]]) if n else 0.0
    backward, after, place = [0.0] * n, [-math.inf] * n, {}
    for r in range(n - 1, -1, -1):
        k = by_start[r]
        place[k] = r
        first = bisect.bisect_left(starts, cands[k][1])
        tail = [0.0, *([after[first]] if first < n else [])]
        total = _log_sum(tail)
        if behind[k]:
            rest = math.exp(total) - sum(math.exp(scores[b] + backward[b]) for b in behind[k])
            total = math.log(max(rest, 0.0) + sum(math.exp(scores[b] + backward[b] + pairs[k, b]) for b in behind[k]))
        backward[k] = total
        after[r] = scores[k] + total if r == n - 1 else _log_sum([after[r + 1], scores[k] + total])
    single = [math.exp(forward[k] + backward[k] - whole) for k in range(n)]
    double = {(a, b): math.exp(forward[a] + w + scores[b] + backward[b] - whole) for (a, b), w in pairs.items()}
    return single, double


def train(given: tuple[str, ...], sentences: int = SENTENCES, epochs: int = EPOCHS, rate: float = 0.3, decay: float = 1e-5) -> Model:
    """Fit the weights by adaptive gradient steps on the conditional likelihood."""
    model = Model(given, defaultdict(float))
    data = []
    for text, spans in Sentences(given)(sentences):
        cands = sorted(model.candidates(text), key=lambda c: (c[1], c[0], c[2]))
        gold = set(spans)
        right = [float(c[:3] in gold) for c in cands]
        pairs = {(a, b): f">{cands[a][2]}>{cands[b][2]}|{gap}" for b in range(len(cands)) for a in range(len(cands)) if 0 <= cands[b][0] - cands[a][1] <= BESIDE and (gap := _beside(text, cands[a][1], cands[b][0])) is not None}
        if cands:
            data.append((cands, right, pairs))
    w, squares = model.weights, defaultdict(float)

    def move(features: list[str], d: float) -> None:
        for f in features:
            step = d - decay * w[f]
            squares[f] += step * step
            w[f] += rate * step / math.sqrt(squares[f] + 1e-6)

    for _ in range(epochs):
        for cands, right, pairs in data:
            single, double = expected(cands, [sum([w[f] for f in c[3]]) for c in cands], {p: w[f] for p, f in pairs.items()})
            for c, g, x in zip(cands, right, single):
                if abs(g - x) >= 1e-3:
                    move(c[3], g - x)
            for (a, b), f in pairs.items():
                d = right[a] * right[b] - double[a, b]
                if abs(d) >= 1e-3:
                    move([f], d)
    return Model(given, {f: x for f, x in w.items() if abs(x) > 1e-3})


_trained: dict[tuple[str, ...], Model] = {}


def model_of(given_names: DataFrame, column: str = "given_name", most: int = 100_000) -> Model:
    """The model for a lexicon of given names; the lexicon must have at most ``most`` entries."""
    names = tuple(sorted(r[0] for r in given_names.where(F.col(column).isNotNull()).select(column).distinct().limit(most + 1).collect()))
    if len(names) > most:
        raise ValueError(f"a lexicon of more than {most} given names is not one")
    if names not in _trained:
        _trained[names] = train(names)
    return _trained[names]


def _mapper(df: DataFrame, model: Model, doc_id: str, text: str, schema: str, run: Callable) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((tuple(model.given), model.weights))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for batch in batches:
            yield run(m, batch)

    return df.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(mapped, schema)


def find(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind, pii_text): each distinct item of each document."""

    def run(m: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if x:
                rows += [(doc, k, t) for k, t in sorted({(k, x[s:e]) for s, e, k in m.segments(x)})]
        columns = list(zip(*rows)) if rows else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], names=["doc_id", "kind", "pii_text"])

    return _mapper(df, model, doc_id, text, "doc_id bigint, kind string, pii_text string", run)


def mask_text(model: Model, text: str | None) -> str | None:
    if not text:
        return text
    out, at = [], 0
    for s, e, k in model.segments(text):
        out += [text[at:s], f"[{k.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def mask(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) with every item replaced by its type in brackets."""

    def run(m: Model, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([mask_text(m, x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return _mapper(df, model, doc_id, text, "doc_id bigint, text string", run)
