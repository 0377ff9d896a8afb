"""Labelled sentences from which the model of personal items is trained.

Each sentence is a pattern with slots; slots in capitals are labelled, slots in small letters
are filled and left unlabelled (they are what must not be taken for an item). Patterns and
word lists are made up for this purpose; surnames, streets, towns and companies are put
together from syllables anew each time, so that none can be learnt by heart.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

# Patterns of sentences with and without items.
WITH_ITEMS = """
Our contact is {NAME} ({EMAIL}).
Contact person: {NAME_R}
Contact: {NAME}, {PHONE}
Signed by {NAME}
Signed {NAME_R}
(signed) {NAME}
Reviewed by {NAME} and {NAME}
Written by {NAME}
Recorded by {NAME_R}, {PHONE}
Authorised by: {NAME}
Best wishes\\n{NAME}\\n{PHONE}
Yours sincerely,\\n{NAME}\\n{EMAIL}\\n{PHONE}
Thanks,\\n{NAME}
Viele Grüße\\n{NAME}\\n{PHONE}
Freundliche Grüße\\n{NAME}\\n{EMAIL}
Ystävällisin terveisin\\n{NAME}\\n{PHONE}
Vänliga hälsningar\\n{NAME}\\n{PHONE}
Bien à vous,\\n{NAME}\\n{PHONE}
Sender: {NAME} <{EMAIL}>
From {NAME} [{EMAIL}]
From: {EMAIL}
From: {NAME}
To: {NAME} <{EMAIL}>, {EMAIL}
Cc: {EMAIL}; {EMAIL}
Reply to ({EMAIL}) or mailto:{EMAIL}
{EMAIL}
mailto:{EMAIL}
Mail {EMAIL} first, then {EMAIL}.
An agreement of {company}, for which {NAME} signs, with {company}, for which {NAME_R} signs.
On behalf of {company}: {NAME}
The lorry was driven by {NAME}, identity card {ID}.
We handed the box to {NAME} at {ADDRESS}.
Neighbour {NAME} took it in at {ADDRESS}.
Hours of {NAME}, insurance number {ID}
{ADDRESS}, please ring for {NAME}
Pay back {money} to {NAME}, {ADDRESS}.
Yesterday {title} {SURNAME} rang, after that {NAME}.
Could you ring {NAME} on {PHONE} before {date}?
{title} {SURNAME} is on leave to {date}; speak with {NAME}.
{title} {SURNAME}
Dear {title} {SURNAME}, we have your letter about {key}.
Hello {NAME}, any news on {key}?
Dear {NAME},
Trip of {NAME}, passport no. {ID}, booked on {key}.
Seen by {NAME} of {ADDRESS}.
{Word} {ADDRESS}
{Word}adresse {ADDRESS}
{Word} {Word} {ADDRESS}
{Word}adresse {ADDRESS}
{Word}osoite {ADDRESS}
{Word}adress {ADDRESS}
{word} {ADDRESS} {word} {word}
{NAME} {word} {word} ({PHONE}).
{Word} {word} {word} ({PHONE}), {word} {EMAIL}.
({PHONE})
{word} {word} {PHONE}
{Word} {PHONE} {word} {word}
{Word} {EMAIL} {word} {word}
{Word} {word} {NAME} {word} {word}.
{Word}: {NAME}
{Word}: {NAME_R}
{word} {word} {NAME}, {word} {word}.
({word}.) {NAME}
({word}.) {NAME_R}
{Word} {word} {ID} {word}.
{Word} {ID}
{NAME} {word} {word} {word}.
{NAME}: {word} {word}
{NAME_R}: {word} {word}
{Word} {word} {NAME} {word} {NAME}.
{Word} av {NAME}
{Word} av {NAME_R} {word} {word}
{Word} {word} av {NAME}, {word}
{Word} {word} {title} {SURNAME} {word}.
{Word} {word} {titlede} {SURNAME}, {word}.
{NAME_R} of {ADDRESS} was there.
Drop-off point {ADDRESS}, attention of {NAME}.
Ship to {ADDRESS}, attn. {NAME_R}.
Building site: {ADDRESS}
according to {NAME}'s message of {date} the {article} are surplus
{NAME} agreed to {money} over the phone, {PHONE}.
{NAME} lives at {ADDRESS} now.
On shift were {NAME}, {NAME}, {NAME_I} and {NAME}.
When {PHONE} is engaged use {EMAIL}.
The old number {PHONE} is dead, ring {PHONE}
Letters go to {ADDRESS}, mails to {EMAIL}.
Take the number {ID} off page {n}.
Owner of the card: {ID}; ceiling {money}.
{key} | {NAME} | {ID} | {money}
{NAME} / {company} / {date}
{NAME}\\n{ADDRESS}
{NAME}\\n{company}\\n{ADDRESS}
Phone {PHONE}, fax {PHONE}
tel. {PHONE}
Tel: {PHONE}
Mobile {PHONE}
Téléphone {PHONE}, courriel {EMAIL}.
{company}\\n{NAME}\\n{EMAIL}\\n{town}
{key}\\n{company}\\n{town}\\n{NAME}\\n{EMAIL}
{company}\\n{town}\\n{NAME_R}\\n{EMAIL}
{company}\\n{town}\\n{NAME_I}\\n{EMAIL}
{company}\\n{town}\\n{PHONE}\\n{n} {article} {n} 4.20 61.75
{company}\\n{ADDRESS}\\n{PHONE}
{NAME}, geboren in {town}, wohnt {ADDRESS}.
Unterschrieben von {NAME_R}, {ADDRESS}
Freigegeben durch {NAME}
{titlede} {SURNAME} fehlt bis {date}; es vertritt {NAME}.
Guten Tag {titlede} {SURNAME}, danke für {key}.
Ihre Ansprechpartnerin ist {NAME}, {EMAIL}
Kontakt: {NAME_R}, {EMAIL}
Fragen beantwortet {EMAIL} oder {PHONE}.
Bitte anrufen: {PHONE}
Der Fahrer zeigte den Ausweis {ID}.
Anschrift: {ADDRESS}
{titlefi} {SURNAME} palaa {date}, häntä tuuraa {NAME}.
Lisätietoja antaa {NAME}, {EMAIL}
Allekirjoittanut {NAME}\\n{ADDRESS}
Hyväksynyt {NAME}, varamies {titlefi} {SURNAME}
Soittakaa {PHONE} kun kuorma tulee.
Henkilötunnus {ID} pitää peittää.
Kuski {NAME}, {ID}
Osoite on {ADDRESS}
Vastaus lähti osoitteeseen {EMAIL}
Godkänd av {NAME} och {titlesv} {SURNAME}
Jag ringde {titlesv} {SURNAME} på {PHONE} i går.
Fråga {NAME}, {EMAIL}
Ring {PHONE} eller skriv till {EMAIL}
Föraren {NAME} ({ID}) kom {date}.
Personnummer {ID} ska bort.
Adressen är {ADDRESS}
{NAME}, {ADDRESS}, fick ett exemplar
Signé par {NAME}, habitant {ADDRESS}.
Accord de {NAME} pour {titlefr} {SURNAME}.
Joindre {NAME} ({EMAIL}) ou {PHONE}
Livrer au {ADDRESS}
Le numéro {ID} est à rayer.
Vu par {titlefr} {SURNAME} et {NAME}
{NAME} was asked to look at line {n} and {NAME_R} at the rest
Is {NAME} the right person for {article}?
Ask {NAME} for the key to hall {n}.
According to {NAME} the {article} are in {town}.
Handed over to {NAME}
The guard, {NAME}, wrote down {PHONE}.
Approved: {NAME}
Prepared by {NAME_R}
"""
WITHOUT_ITEMS = """
{company} owes us a credit of {money} for {key}.
{company} has billed in another currency than agreed.
Rechnung von {company} liegt bei, Fracht extra.
{company} lähetti muistutuksen, viite puuttuu.
{company} har fakturerat {money} för mycket.
{company} doit encore {money}.
INVOICE\\nNUMBER   DATE   REFERENCE\\n{key}   {date}   {key}
{company}\\n{town}
{key}   {date}   {key}\\n{company}\\n{town}
The truck left {town} on {date}, bill of lading {lot}.
On {date} we counted {n} of {n} boxes for note {lot}.
Batch {lot} is on hold since {date}.
Erä {lot} tarkastetaan {date}.
Varasto on {town}, kuorma {lot}.
Parti {lot} är stoppat.
Der Schein {lot} ist nicht da, die Ware liegt in {town}.
Il manque le bon {lot}.
Gross weight {n} kg, tariff heading {lot}.
Item {lot}: {article}, ready in {n} days from {town}.
Our ref. {key}, yours {lot}.
VAT registration ZZ{lot} is printed below.
Case {lot} in queue finance
Cents are lost when every line is rounded by itself.
Write {key} and the position on all boxes.
Can the goods be sent by {date}?
The pink sheet is for the driver, the white one for finance.
Packing list and shipping note do not agree on {article}.
Public money pays {money} of this order.
There are {n} days of grace. Design is charged by the hour.
Hey @finance-crew: original or duplicate of {key}?
Row {n}, rack {n}, level B holds the pallets.
Confirmed in hall A; {town} sends what is left.
Does {key} cover {article}? Purchasing should know.
{n} {article} {n} 31.75 412.75
Position {n}: {article}, {n} pieces at {money}.
Pos. {n}: {article}, {n} pcs @ 8.15 each.
Prices exclude tax, packing is included.
The new list of {date} has {n} entries and supersedes the old one.
Hidden damage must be reported within {n} days.
Nettopreise, Verpackung inbegriffen.
Maksuaika {n} päivää, sopimuksessa {key} on toisin.
Subject: {key} once more
Re: Fwd: {key} / {article}
SUM {money}\\nTAX {money}\\nTO PAY {money}\\nPage 2 of 3
Put {key} on each sheet or the archive will lose it.
Under clause {n} the maximum holds to the end, later orders notwithstanding.
Paragraph {n} is void; Art. {n} stands, and Will is a verb there.
The paper says {n} days net, {key} says {n}.
Accrued amount for {key} released in month {n}.
{key} closed, {n} pieces never came.
{key} entered two times, by mistake.
The heading hid the figures, so tax and net were unreadable.
It's been read as a row of the table again; they've promised to shift it.
They've added transport costs, which the contract forbids.
The seller doesn't print a rate of tax, hence no check of row {n}.
Please don't release it, the rows are blocked.
Rates are ceilings; more than that needs approval in writing.
Either side may terminate with {n} days' notice.
In January prices follow the index, {n} days late.
Differences below one euro are ignored by us.
The price in row {n} exceeds the limit of {key} by {money}.
The scan is tilted and figures overlap: {money} {money} {n}.{n}.
The total is wrong: printed {money}, computed {money}.
An overdue charge of {money} has no ground in {key}.
Proof: page {n}, sum block, {money}; a stamp covers the digits.
The window for delivery moved to {date}.
Second copy of {key}, settled on {date}, delete.
Nothing was attached, {article} could not be booked in.
{n} of {article} came on {date}; {n} were charged.
{article} is listed at {money} apiece.
Goods stay ours until {money} is paid.
The marks on the crate differ and the stamp is faint.
Maße und Größe stimmen nicht mit dem Auftrag überein.
Die Steuer fehlt und wird nicht angenommen.
Zeile {n}: Preis über der Grenze.
Der Auftrag {key} ist offen.
Frist {n} Tage, siehe {key}.
Wir erwarten eine Gutschrift von {money}.
Am {date} kamen {n} Stück {article}.
Die Zeilen ergeben {money}, auf {key} steht {money}.
Veroa ei näy, emme arvaa sitä.
Erotus johtuu pyöristyksestä.
Rivillä {n} hinta on liian korkea.
{key} odottaa yhä.
Hinta ilman veroa, pakkaus kuuluu siihen.
Pyydetään hyvitys {money}.
{key}: summa {money} on väärin.
{article} tuli {date}, {n} kpl.
Öresavrundning bokförs utan anmärkning.
{n} dagar netto, se {key}.
Pris utan moms, med emballage.
Sedeln saknas och varorna är i {town}.
{key} är öppen.
Rad {n} ligger över taket.
Skillnaden i {key} är {money}.
{n} st {article} kom {date}.
{key} reste ouverte.
Un écart d'arrondi, sans suite.
Paiement à {n} jours, voir {key}.
Ligne {n} : prix trop élevé.
{n} pièces de {article} reçues le {date}.
{key} : total {money}, lignes {money}.
{key} takes over from {key}; may, will, mark and bill are verbs there.
REFERENCE   START   END
{key}   {date}   {date}
{company}
ORDER
NUMBER   DATE   CONTRACT
{n} {article} 7 88.10 616.70
{n}   {article}                    {n}       9.40       385.40
{n}  {article}              4        3.15        12.60
SUBTOTAL 1090.55
VAT TOTAL 77.40
TOTAL DUE 3480.10
Page 3 of 5
SUBTOTAL EUR 12,840.75
TOTAL DUE 2,310.90 EUR
VALUE OF ORDER {money}
Date: {date}
Sent: {date}
----- Forwarded message -----
{n} hours went to {key}; week {n} has no signature.
{article} from {town} and {article} from {town} were mixed up
Meeting in {town} on {date}, room {n}
Quality, Logistics and Purchasing were told. Nobody from Finance came.
{title} {SURNAME} {ord} {word} {word} {date}.
{titlede} {SURNAME} {word} {word}.
{NAME} {ord} {word} {word}.
{Ord} {word} {word} {word}.
{Ord} the {word} {word}.
{Ord} and {Ord} {word} {word}
{word} {ord} {word} {word}.
{Word}, {Ord} {word} {word} {word}.
{Word}, {Ord} {word}: {article}
{Word} {Word}, {Ord} {word}
{Ord}. no. {lot}: {article}
{word} {word} {company}. {Ord} {word} {word}
{word} {word} {article}. {Ord}. no. {lot}
{NAME_R} {Ord} {word} {word}
{NAME} {Ord} {word} {word}
{town}\n{NAME}\n{EMAIL}
{company}\n{town}\n{NAME}
{company}\n{town}\n{NAME}\n<{EMAIL}>
{word} {article} {word} {date}, {word}
{n} {word} {article} {word}
{Word} {word} {word} {word} {word}.
{Word} {word} {Word} {word} {word} {Word}.
{Word} {Word} {word} {word}, {word} {word} {word}
{word} {word} {word} {word} {word} {word}
{Word} {lot} {word} {word}
{word} {lot}, {n} {word} {n} {word} {date}
{Word} {word} {lot} {word} {word} {date} {word} {word}.
{Word} {word} {n}, {word} {n} {word}, {word} {word} {lot}.
{Word}: {lot}
{Word} no. {lot}: {article}
{Word} {money} {word} {word} {company}.
{Word} {Word} {money}
{Word} {date} {Word} {word}, {Word} {word}.
{Word} {Word}: {Word} {word} {n}
The {word} {word} the {word} {word}, and {word} {word} by {word} {word}.
We sold the old Press Line to {company} in {town}.
"""
LEADS = ("", "", "", "", "", "Note: ", "By the way: ", "As said, ", "FYI, ", "PS, ", "NB ",  "Second: ", "> ", "* ", "- ", "2) ", "Übrigens: ", "Notiz: ", "Huomio: ", "Myös: ", "Obs: ", "Till sist: ", "À noter : ", "Enfin : ", "(", "Update ")
#: Endings of surnames in this project's documents that are not common elsewhere; taken from documents that were read, not from general knowledge.
LOCAL_ENDS = ("brask", "ecke", "vonen", "kki", "eri", "ovan", "strömer", "lander")
#: Endings that surnames of many countries have, and those; a word that ends so is like a surname.
SURNAME_ENDS = (
    *LOCAL_ENDS,
    "son", "sson", "sen", "nen", "inen", "lainen", "berg", "borg", "burg", "bury", "mann", "stein", "feld", "ström", "strom", "quist", "qvist", "kvist", "lund", "gren", "gaard", "gård", "holm", "holt", "ski", "sky", "ovsky",
    "wicz", "vich", "ova", "enko", "escu", "ez", "etti", "elli", "ier", "ière", "eau", "ault", "dale", "wick", "ford", "worth", "meyer", "maier", "bauer", "huber", "müller", "idis", "opoulos",
)
ONSETS = ("B", "Br", "D", "Dr", "F", "Fr", "G", "Gr", "H", "K", "Kr", "L", "M", "N", "P", "Pr", "Qu", "R", "S", "Sch", "Sk", "St", "T", "Tr", "V", "W", "Z", "Ch", "Th", "Hj", "", "Cl", "Sp")
VOWELS = ("a", "e", "i", "o", "u", "ä", "ö", "å", "ai", "ei", "ie", "au", "ü", "é", "y", "ou")
CODAS = ("", "l", "n", "r", "s", "m", "nd", "rk", "lm", "st", "ll", "rn", "t", "ck", "x", "nt", "rs")
TRADES = ("Trading", "Group", "Service", "Systems", "Works", "Technik", "Industrial", "Logistics", "Engineering", "Supplies", "Handling", "Tools", "& Sons", "Nord", "Materials", "Components")
FORMS = ("Oy", "Oyj", "AB", "AS", "GmbH", "BV", "SARL", "Ltd", "AG", "SA")
ARTICLES = ("Ball valve", "Hex bolt", "Air filter", "Drive belt", "Junction panel", "Steel plate", "Cable reel", "Safety glove", "Pump seal", "Roller bearing", "Wall anchor, light", "Fire door", "Pressure gauge", "Fork truck rental", "Night shift, guard", "Paper roll", "Copper pipe", "Mixer shaft", "Rail clamp", "Tank sensor", "Cold store panel", "Label ribbon", "Hose clip", "Crane hook", "Power supply", "Rope", "Skip hire", "Boiler check")
MEASURES = ("# kg", "## mm", "### mm", "## cm", "# m", "## l", "### l", "#kW", "## kW", "##000 W", "## bar", "##BAR", "## M", "# L")
#: Given names that are ordinary words as well.
ORDINARY = ("Will", "Mark", "May", "Rose", "Grace", "Penny", "Grant", "Art", "Bill", "Frank", "Dawn", "Hope", "Faith", "Joy", "Chase", "Miles", "Rich", "Pat", "Sue", "Drew", "Rob", "Jack", "Heath", "Ray", "Iris", "April", "June", "Violet", "Victor", "Guy", "Max", "Josh", "Gene", "Dale", "Cliff", "Clay", "Glen", "Rusty", "Sandy", "Skip")
# Parts of streets in five languages.
STREETS_EN = ("Road", "Street", "St", "Lane", "Way", "Close", "Yard", "Ave.", "Avenue", "Rd", "Court", "Drive", "Place", "Square")
STREETS_DE = ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ufer", "damm")
STREETS_SV = ("gatan", "gata", "vägen", "stigen", "gränd", "torget", "plan", "backen")
STREETS_FI = ("katu", "tie", "polku", "kuja", "raitti", "ranta", "kaari", "rinne")
STREETS_FR = ("rue", "avenue", "av.", "allée", "chemin", "quai", "place", "boulevard", "impasse")
BEFORE_DE = ("Am", "An der", "Auf dem", "Im", "Zum", "Unter den")
MAILBOXES = ("info", "sales", "invoices", "orders", "office", "support", "no-reply", "hr.team", "finance-dept", "reception", "procurement", "kundservice", "buchhaltung", "laskut")
ENDINGS = ("example", "test", "invalid", "com", "co.uk", "de", "fi", "se", "fr", "org")


def _plain(text: str) -> str:
    for a, b in zip("äöåéèüßó'", "aoaeeusoo"):
        text = text.replace(a, b)
    return text.lower().replace("-", "")


class Sentences:
    """Seeded generator of (text, [(start, end, kind)])."""

    def __init__(self, given: tuple[str, ...], seed: int = 7) -> None:
        self.r = random.Random(seed)
        self.given = given or ("Alex", "Maria")
        lines = lambda x: [p.replace("\\n", "\n") for p in x.strip().split("\n")]
        self.patterns = (lines(WITH_ITEMS), lines(WITHOUT_ITEMS))

    def digits(self, form: str) -> str:
        return "".join(str(self.r.randrange(10)) if c == "#" else c for c in form)

    def word(self, syllables: int | None = None) -> str:
        """A made-up word with a capital."""
        r = self.r
        out = "".join(r.choice(ONSETS).lower() + r.choice(VOWELS) + (r.choice(CODAS) if r.random() < 0.6 else "") for _ in range(syllables or r.choice((1, 2, 2, 2, 3))))
        return out.capitalize() if len(out) > 2 else self.word(2)

    def filler(self) -> str:
        """A made-up word of running text, which may end as surnames do."""
        r = self.r
        out = self.word(r.choice((1, 2, 2, 3))).lower()
        return out + r.choice(SURNAME_ENDS) if r.random() < 0.3 else out + r.choice(("s", "ed", "ing", "en", "t", "a", "er", "et", "", "", "", "is", "an"))

    def first(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.6:
            return r.choice(self.given)
        if x < 0.88:
            name = self.word(r.choice((1, 2, 2, 3)))
            return f"{name}-{self.word(1)}" if r.random() < 0.05 else f"O'{name}" if r.random() < 0.02 else name
        return f"{r.choice('ABCDEFGHIJKLMMMMNOPRSTUVW')}."

    def surname(self) -> str:
        r = self.r
        one = lambda: self.word(r.choice((1, 1, 2))) + r.choice(SURNAME_ENDS) if r.random() < 0.7 else self.word(r.choice((2, 2, 3)))
        name = one()
        return f"{name}-{one()}" if r.random() < 0.08 else name

    def cased(self, text: str, low: float = 0.05, up: float = 0.08) -> str:
        x = self.r.random()
        return text.lower() if x < low else text.upper() if x < low + up else text

    def name(self, initial: bool = False) -> str:
        r = self.r
        first = f"{r.choice('ABDEGHJKLMNPRST')}." if initial else self.first()
        x = r.random()
        middle = "".join(f"{r.choice('ABCDEFGHJKLMRST')}. " for _ in range(r.choice((1, 1, 1, 2)))) if x < 0.18 else r.choice(("de ", "von ", "van ", "van der ", "von der ", "de la ", "le ", "du ", "af ")) if x < 0.26 else ""
        if x > 0.94:
            middle = "".join(f"{r.choice(self.given)} " for _ in range(r.choice((1, 1, 2, 3)))) + r.choice(("", "", "", "van ", "de la "))
        elif 0.18 > x > 0.16:
            middle += r.choice(("von ", "van der ", "de "))
        gap = "  " if r.random() < 0.06 else "\n" if r.random() < 0.02 else "\xa0" if r.random() < 0.02 else " "
        # in small letters throughout only where the given name is one of the list
        return self.cased(f"{first}{gap}{middle}{self.surname()}", 0.08 if first in self.given else 0.05)

    def street(self) -> str:
        r = self.r
        n = str(r.randrange(1, 250))
        kind = r.choice(("en", "en", "de", "sv", "fi", "fr"))
        gap = ", " if r.random() < 0.6 else "\n"
        unit = r.choice(("", "", "", "", "a", "b", " A", " B 7", " A 12", " as. 3", f"-{int(n) + 2}"))
        if kind == "en":
            named = r.choice((self.word(), self.word(), f"Old {self.word()}", f"{self.word()}'s", "High", "Mill", f"{self.word()} {self.word()}"))
            head = r.choice(("", "", "", "Flat 3, ", "Unit 6, ", "Bldg C, ", "Suite 12, ")) + f"{n}{r.choice(('', '', 'a', 'b'))} {named} {r.choice(STREETS_EN)}{r.choice(('', '', '', '', '', '', ', Suite 40', ', Flat 2'))}"
            tail = f"{self.word()}{r.choice(('', '', ' Heath', ' Green'))} {r.choice(('QX', 'B', 'LS', 'ZE', 'N'))}{self.digits('##')} {self.digits('#')}{r.choice(('ZZ', 'AB', 'QT'))}"
        elif kind == "de":
            named = f"{r.choice(BEFORE_DE)} {self.word()}" if r.random() < 0.25 else r.choice(("", "", "", "", "", "", "Alte ", "Neue ", "Große ")) + self.word(r.choice((1, 2))) + r.choice(STREETS_DE)
            head, tail = f"{named} {n}{unit}", f"{self.digits('#####')} {self.word()}"
        elif kind == "sv":
            head, tail = f"{r.choice(('', '', '', '', '', 'Gamla ', 'Lilla '))}{self.word(r.choice((1, 2)))}{r.choice(STREETS_SV)} {n}{unit}", f"{self.digits('### ##')} {self.word()}"
        elif kind == "fi":
            head, tail = f"{r.choice(('', '', '', '', '', 'Vanha ', 'Uusi '))}{self.word(r.choice((1, 2)))}{r.choice(STREETS_FI)} {n}{unit}", f"{self.digits('#####')} {self.word()}"
        else:
            named = r.choice((f"{r.choice(('du ', 'des ', 'de la ', 'de '))}{self.word()}", self.word(), f"de l'{self.word()}", f"du {self.word()}-{self.word()}", f"des {self.word()}-{self.word()}"))
            head, tail = f"{n}{r.choice(('', '', '', ' bis', ' ter', ' bis,', ',', ','))} {r.choice(STREETS_FR)} {named}", f"{self.digits('#####')} {self.word()}{r.choice(('', '', f'-sur-{self.word(1)}'))}"
        return self.cased(head + gap + tail if r.random() < 0.6 else head, 0.01, 0.06)

    def email(self) -> str:
        r = self.r
        host = f"{r.choice(('', '', '', 'mail.', 'post.'))}{self.word().lower()}{r.choice(('', '', f'-{self.word(1).lower()}', '-works'))}.{r.choice(ENDINGS)}"
        a, b = _plain(r.choice(self.given)), _plain(self.surname())
        local = r.choice((f"{a}.{b}", f"{b}_{a}", f"{a}{r.randrange(100)}", f"{a[:1]}{b}", f"{a}.{b}+{r.choice(('po', '2025', 'inv'))}", f"{a}", r.choice(MAILBOXES), r.choice(MAILBOXES)))
        if r.random() < 0.72:
            return self.cased(f"{local}@{host}", 0.0, 0.06)
        at = r.choice((" (at) ", " [at] ", "[at]", "(at)", " @ ", " at ", "(ät)", " {at} "))
        return f"{local}{at}{host.replace('.', ' dot ') if r.random() < 0.6 else host}"

    def phone(self) -> str:
        """Numbers of several countries; the groups of many are made up, so that no form is learnt by heart."""
        r = self.r
        if r.random() < 0.45:
            lead = r.choice(("+4#", "+4#", "+35#", "+999", "+33", "+1", "004#", "0", "0", "0"))
            groups = [self.digits("#" * r.choice((2, 2, 3, 3, 4))) for _ in range(r.choice((2, 3, 3, 4)))]
            sep = r.choice((" ", " ", ".", "\xa0"))
            code = self.digits(r.choice(("#", "##", "###", "(0)##", "##-#", "###")))
            text = f"{self.digits(lead)}{' ' if lead != '0' else ''}{code}{r.choice((' ', '-', ' / ', sep))}{sep.join(groups)}"
            return text if 7 <= sum(c.isdigit() for c in text) <= 14 else self.phone()
        return self.digits(r.choice((
            "+44 #### ######", "+44##########", "0#### ######", "0#### ### ###", "+44 (0)#### ######", "+49 ## #####-###", "0## / ##### ###", "0##-#######", "0#-### ### ##", "0##-### ## ##",
            "+46 (0)##-### ## ##", "###-###-####", "(###) ###-####", "+1 ###.###.####", "+999-##-######", "+999 # ###\xa0###", "+999 ##\n### ####", "+999 ## ### ####", "+999 # ######",
            "0# ## ## ## ##", "+33 # ## ## ## ##", "0#.##.##.##.##", "00##########", "0### ########",
        )))

    def id(self) -> str:
        r = self.r
        letters = lambda n: "".join(r.choice("ABCEGHJKLMNPQRSTWXYZ") for _ in range(n))
        form = self.digits(r.choice(("###-##-####", "### ## ####", f"{letters(2)}######{r.choice('ABCD')}", f"{letters(2)} ## ## ## {r.choice('ABCD')}", f"######-###{letters(1)}", f"######A###{letters(1)}", "######-####", "1 ## ## ## ### ### ##", "2##############", f"{letters(2)}#######", "########-####")))
        return form.lower() if r.random() < 0.05 else form

    def article(self) -> str:
        """A goods description: name, code and measure, of which one may be missing, in any order after the name."""
        r = self.r
        code = f"{r.choice('ABDFGHKLMNPRSTWXZ')}{r.choice('CEGJKLMNRTWZ')}{r.choice(('-', '/', ' ', '', '.'))}{self.digits('###')}"
        parts = [x for x in (code, self.digits(r.choice(MEASURES))) if r.random() < 0.85]
        r.shuffle(parts)
        name = r.choice(ARTICLES) if r.random() < 0.6 else f"{self.word()} {self.word().lower()}{r.choice(('', '', f' {self.word(1).lower()}'))}"
        parts.insert(0 if r.random() < 0.9 else len(parts), name)
        return self.cased(r.choice((" ", " ", " - ", ", ")).join(parts) + r.choice(("", "", "", "", " *", " new")), 0.1, 0.12)

    def lot(self) -> str:
        return self.digits(self.r.choice(("0##-####-###", "## ### ####", "##/####-#", "LOT#######", "## ####/##", "L-######")))

    def company(self) -> str:
        r = self.r
        middle = r.choice(TRADES) if r.random() < 0.75 else self.word()
        return self.cased(f"{self.word()}{f'-{self.word(1)}' if r.random() < 0.05 else ''} {middle} {r.choice(FORMS)}", 0.05, 0.08)

    def date(self) -> str:
        return self.digits(self.r.choice(("2025-0#-1#", "1#/#/2025", "1#/1#/2025", "2#/12/2025", "1#.1#.2025", "1#.#.2025", "#.#.2025", "#/#/2025", "2#.#.", "#.#.", "0#.0#.2025", "2025-1#-0#")))

    def fill(self, slot: str) -> tuple[str, str | None]:
        r = self.r
        if slot in ("NAME", "NAME_I"):
            return self.name(slot == "NAME_I"), "name"
        if slot == "NAME_R":
            first = self.first()
            return self.cased(f"{self.surname()}, {first}", 0.05 if first in self.given else 0.0), "name"
        if slot == "SURNAME":
            return self.cased(self.surname(), 0.02, 0.05), "name"
        if slot in ("EMAIL", "PHONE", "ADDRESS", "ID"):
            kind = {"EMAIL": "email", "PHONE": "phone", "ADDRESS": "address", "ID": "id_number"}[slot]
            return {"email": self.email, "phone": self.phone, "address": self.street, "id_number": self.id}[kind](), kind
        return {
            "Ord": lambda: r.choice(ORDINARY), "ord": lambda: r.choice(ORDINARY).lower(), "Word": lambda: (self.filler if r.random() < 0.5 else self.word)().capitalize(), "word": self.filler, "company": self.company, "town": lambda: self.word(r.choice((2, 3))) + r.choice(("", "", "", " Heath", "-sur-Loire")), "article": self.article,
            "key": lambda: self.digits(r.choice(("PO-00#########", "CTR-######", "INV-2025-0000####"))), "lot": self.lot, "n": lambda: str(r.randrange(1, 400)), "date": self.date,
            "money": lambda: self.digits(r.choice(("EUR #,###.##", "##.## EUR", "€###.##", "SEK ##,###.##", "### euros", "#,###.##", "#.###,## EUR"))),
            "title": lambda: r.choice(("Mr", "Mrs", "Ms.", "Dr", "Ms", "Mr.", "Prof")), "titlede": lambda: r.choice(("Herr", "Frau", "Dr.", "Herrn")), "titlefi": lambda: r.choice(("hra", "rva", "herra", "rouva")),
            "titlesv": lambda: r.choice(("herr", "fru")), "titlefr": lambda: r.choice(("M.", "Mme", "Mlle", "Monsieur", "Madame")),
        }[slot](), None

    def __call__(self, count: int) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
        for _ in range(count):
            text, spans = "", []
            for k in range(self.r.choice((1, 1, 2, 3))):
                text += (self.r.choice(("\n", "\n", " ")) if k else "") + self.r.choice(LEADS)
                rest = self.r.choice(self.patterns[self.r.random() < 0.45])
                while "{" in rest:
                    before, _, rest = rest.partition("{")
                    slot, _, rest = rest.partition("}")
                    text += before
                    filled, kind = self.fill(slot)
                    if kind:
                        spans.append((len(text), len(text) + len(filled), kind))
                    text += filled
                text += rest
            if self.r.random() < 0.1 and len(text.upper()) == len(text):
                text = text.upper()
            yield text, spans
