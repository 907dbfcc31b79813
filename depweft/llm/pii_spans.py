"""High-recall candidates for personal data in a text, and what tells true ones from false.

Generators propose overlapping spans of each kind; features describe a span's own form and its surroundings on the line. No
list of given or family names is used: what makes a name is form, context, and that its words are rare in lower case.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np

KINDS = ("email", "phone", "id", "address", "name")
BEFORE, AFTER = 48, 36

# ---- words that speak for or against a kind: fixed values, in English, Spanish, French and German. They are the labels, prepositions and
# verbs that such items commonly stand beside, written down from general knowledge and not from the texts of the tables. ----

CUES = {
    "email": "mail email emails mails correo correos electrónico courriel courriels électronique e-mail mailto mailbox inbox from to cc bcc reply reply-to write contact contacto kontakt escribir escribe escríbeme escríbanos écrire écrivez schreiben schreibe erreichbar joindre send envía envoyer senden address dirección adresse user login account cuenta compte konto",
    "phone": "tel tél telf tlf tfno fono telephone teléfono téléphone telefon telefonnummer telefonisch phone phones phoned mobile mobil móvil celular portable handy cell call calls called llame llamar llama llámeme appeler appelez joindre joignable anrufen anruf rückruf ring dial sms text whatsapp fax hotline line landline number número numéro nummer rufnummer extension durchwahl t",
    "id": "id ids dni d.n.i nif cif nie ssn nino ni nin passport passports pasaporte passeport reisepass reisepassnummer identity identification identidad identificación identité ausweis personalausweis personalausweisnummer ausweisnummer national nacional nationale nationalität insurance seguro seguridad assurance versicherung sozialversicherungsnummer versicherungsnummer social sociale sécurité security tax taxpayer fiscal fiscale steuer steuer-id steuernummer residence residencia residente séjour aufenthaltstitel card carnet tarjeta carte karte licence license permit permiso permis document documento document dokument dokumentennummer titular holder bearer",
    "address": "address addresses dirección domicilio adresse anschrift lieferadresse rechnungsadresse domicile residence resides residing reside residente live lives lived vive vivo vivimos vivir habite habitant demeurant wohne wohnt wohnhaft based located located ubicado situada sita situé office oficina bureau büro sede siège sitz deliver delivery deliveries entrega envío enviar livrer livraison liefern lieferung ship shipping shipped mail parcel paquete colis paket post postal send sent moved home house casa maison haus street calle visit visite besuchen meet treffen",
    "name": "by from with for to of and name names named nombre llamo llama nom appelle heiße heißt author authors autor autora auteur autrice autorin signed firmado firmada signé unterzeichnet approved aprobado approuvé written escrito écrit rédigé verfasst bearbeitet reviewed revisado owner propietario maintainer manager assignee responsable responsible verantwortlich ansprechpartner sachbearbeiter sachbearbeiterin contact contacto kontakt speaker customer cliente client kunde kundin patient paciente colleague compañero collègue kollege kollegin employee empleado employé mitarbeiter student alumno regards saludos saludo cordialement grüße grüßen sincerely yours atentamente thanks gracias merci danke dear hi hello hola bonjour hallo estimado estimada querido querida cher chère lieber liebe geehrter geehrte mr mrs ms miss dr prof sr sra srta señor señora don doña m mme monsieur madame herr frau attn cc according según selon laut told met asked ask tell spoke hablé parlé sprach por para con de par avec à von mit an für user copyright",
}
CUES_AFTER = {
    "email": "or oder o ou and y et und for para pour für if si wenn with con",
    "phone": "or o ou oder ext extension between entre zwischen after before mornings evenings",
    "id": "issued expedido délivré ausgestellt expires caduca expire valid válido holder card carnet tarjeta carte number número",
    "address": "or o ou oder and y et und floor piso étage stock",
    "name": "said says wrote writes asked replied answered called told joined left approved signed reported will has was is and dijo escribió pidió respondió llamó firmó avisó confirmó a est dit écrit répondu appelé demandé signé hat ist schrieb sagte fragte antwortete bat rief",
}
AGAINST = set(
    "part parts component components spare serial sn no batch batches lot lots charge ticket tickets case cases order orders job jobs task process pid invoice invoices sku article articles item items product products model build builds version versions release releases revision "
    "commit commits hash hashes checksum digest fingerprint sha sha1 sha256 md5 uuid guid isbn issn doi port ports lines page pages figure figures fig table chapter section row rows column record records offset size bytes index request requests session trace timeout error errors code status "
    "step steps clone checkout branch tag merge module package packages import class function method plugin image images icon file files folder path repository repo remote docker npm pip release guide tutorial handbook manual menu button tab screen view layout theme stock inventory warehouse tracking parcelid "
    "pieza piezas artículo artículos lote lotes serie pedido pedidos factura facturas tique incidencia versión página páginas figura tabla línea fila filas puerto proceso paso archivo archivos carpeta huella resumen código "
    "pièce pièces lot série commande commandes facture ticket page figure tableau ligne lignes port étape fichier fichiers dossier empreinte code "
    "teil teile artikel los serie bestellung auftrag rechnung seite abbildung tabelle zeile zeilen schritt datei dateien ordner prüfsumme".split()
)
#: Words that organisations, places, products and works bear in their names and people seldom do, and words of the calendar.
NO_PERSON = set(
    "united nations union national international european american african asian global world royal federal central general public free open first new old great upper lower north south east west northern southern eastern western san santa saint los las "
    "university college school institute academy foundation association society council committee ministry department agency bank insurance airlines airways railways group holding company corporation inc ltd llc gmbh corp limited partners solutions systems services technologies technology software hardware labs laboratory studio studios cloud web network networks data "
    "code server client desktop mobile office windows linux apache google microsoft amazon oracle red hat visual power home assistant engine framework library platform store market express press news times journal review museum gallery theatre theater hotel restaurant hospital airport station park garden river lake mountain valley island bridge street road avenue square city town county state republic kingdom "
    "street view table search sort main index report guide manual rule list map chart step release notes terms conditions privacy policy rights license "
    "monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october november december lunes martes miércoles jueves viernes sábado domingo enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre "
    "lundi mardi mercredi jeudi vendredi samedi dimanche janvier février avril juin juillet août septembre octobre novembre décembre montag dienstag mittwoch donnerstag freitag samstag sonntag januar februar märz mai juni juli oktober dezember".split()
)
#: Fixed value: frequent given names of the four languages, a hint beside form and context.
GIVEN = set(
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark steven paul andrew george kevin brian edward peter henry jack oliver harry samuel benjamin alexander mary patricia jennifer linda elizabeth susan jessica sarah karen nancy lisa margaret emily emma olivia sophia alice helen laura anna kate rachel rebecca grace ruth jane "
    "antonio josé manuel francisco juan luis carlos miguel rafael pedro pablo jorge alberto fernando diego sergio javier andrés ramón enrique marcos maría carmen ana isabel dolores pilar teresa rosa cristina marta lucía elena paula raquel silvia beatriz julia sofía irene alba nuria inés "
    "jean pierre michel andré philippe rené louis alain jacques bernard marcel claude nicolas julien antoine luc marie jeanne françoise monique catherine nathalie isabelle sylvie camille claire chloé manon élise juliette "
    "hans peter klaus wolfgang jürgen dieter günter stefan andreas thomas markus sebastian lukas felix jonas ursula monika petra sabine renate helga karin brigitte anja katrin lena greta mohamed ahmed ali fatima yusuf wei li raj priya ivan olga anastasia".split()
)
#: Function words, openers of sentences and labels: no part of a name or a town.
COMMON = set(
    "the a an and or of in on at to for with by from is are was were be this that these those it its our your my we you they he she his her their i if when why how what where who which not no yes any all some each every both more most other "
    "ask call write reach ship send hello hi dear good morning afternoon evening night thanks thank best kind warm regards sincerely yours according reported reviewed signed approved author owner contact name address phone tel fax cell email mail identity document passport social security national insurance form card tax "
    "yesterday today tomorrow tonight later then finally also maybe perhaps meanwhile again now here there once soon two three four five six seven eight nine ten last next ayer hoy mañana luego después nos le me lo les ya hier aujourd'hui demain puis ensuite gestern heute dann danach später unser unsere mein meine ihr ihre sein seine dieser diese dieses kein keine "
    "please see note since before after summary open question only nothing nobody evidence copyright license all rights reserved deliver delivery customer client manager speaker billing shipping office user speak questions approved minutes "
    "el la los las un una unos unas y o de del en con por para al su sus mi tu es son según hola buenos buenas días tardes noches saludos saludo gracias atentamente dirección domicilio teléfono telefono contacto correo pasaporte documento identidad llamar escribir estimado estimada querido querida firmado cliente responsable número "
    "le les des du et ou dans avec pour par sur au aux ce cette ces son sa ses mon ma bonjour bonsoir salut merci cordialement adresse selon cher chère passeport numéro rédigé signé madame monsieur "
    "der die das den dem ein eine einer und oder im am vom zum zur mit für von bei ist sind hallo guten tag morgen abend freundlichen viele liebe lieber grüße grüßen anschrift adresse laut danke rückruf telefon reisepass personalausweis steuernummer ansprechpartner "
    "nif nie dni ssn nino passport part order ticket batch serial job release version figure page chapter table build use do edit code generated file".split()
)
TITLES = set("dr dra prof sr sra srta mr mrs ms miss mme mlle herr frau don doña señora señor señorita madame monsieur lic ing".split())
PARTICLES = "de|del|la|las|los|van|von|der|den|di|da|dos|du|le|ter|ten|zu|af|y|e|bin|ibn|al|DE|DEL|LA|LAS|LOS|VAN|VON|DER|DEN|DI"
_PARTICLE_SET = {w.lower() for w in PARTICLES.split("|")}
FILE_ENDINGS = set("png jpg jpeg gif svg webp js ts css html json xml yml yaml py rb go java md txt zip gz tar pdf lock map min".split())
DIAL_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "354", "358", "420", "421", "593", "598")
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

# ---- generators ---------------------------------------------------------------------------------------------------

_AT = r"(?:\s?[\[({<]\s?(?:at|arroba|ät|chez|AT|@)\s?[\])}>]\s?|[ ](?:at|AT|arroba)[ ]|[ ]@[ ])"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|punto|point|punkt|DOT|\.)\s?[\])}>]\s?|[ ](?:dot|DOT|punto|point|punkt)[ ])"
_PLAIN_MAIL = re.compile(r"(?<![\w.+%@/-])[\w%+][\w.%+'-]{0,63}@[\w-]+(?:\.[\w-]+)+")
_VEIL = re.compile(rf"{_AT}(?=[\w-]+(?:\.|{_DOT})[\w-])")
#: The word or sign in the middle of _VEIL, between brackets or blanks: a plain search for it comes first, as few texts hold one.
_VEIL_CORE = re.compile(r"[aAä@c](?<=[\s(\[{<].)(?:(?<=[aä])t|(?<=A)T|(?<=a)rroba|(?<=c)hez|(?<=@))(?=[\s)\]}>])")
_VEILED_LOCAL = re.compile(rf"(?:^|(?<=[^\w.+%@/-]))[\w%+][\w%+-]*(?:(?:\.|{_DOT})[\w%+-]+)*$")
_VEILED_DOMAIN = re.compile(rf"[\w-]+(?:(?:\.|{_DOT})[\w-]+)+")
_GAP = "   "
# The sign looked for first is a plain class, so that the scan of a whole text is fast.
_PHONE = re.compile(rf"[+(\d](?<![\w.+/#@:-].)(?<!\d[{_GAP}].)(?:(?<=\+)\d|(?<=0)0\d|(?<=\()\+?\d|(?<=\d))[\d{_GAP}().\-/‐-–]{{4,22}}\d(?![\w@]|[-/.:]\w)")
#: A number with decimal places is no phone number, unless a word on its line says so.
_DECIMAL = re.compile(r"\d{1,3}\.\d{4,}")
_PHONE_CUES = frozenset(CUES["phone"].split())
_CUE_WORD = re.compile(r"[^\W\d_]+")
_IDS = [
    (0, re.compile(r"(?<![\w.-])[0-9]{8}[- ]?[A-Z](?![\w-])|(?<![\w.-])[0-9]{8}-?[a-z](?![\w-])")),
    (1, re.compile(r"(?<![\w.-])[0-9]{2}[. ][0-9]{3}[. ][0-9]{3}[- ]?[A-Za-z](?![\w-])")),
    (2, re.compile(r"(?<![\w.-])[XYZxyz][- ]?[0-9]\.?[0-9]{3}\.?[0-9]{3}[- ]?[A-Za-z](?![\w-])")),
    (3, re.compile(r"(?<![\w.-])[A-Za-z]{2}[ -]?[0-9]{2}[ -]?[0-9]{2}[ -]?[0-9]{2}[ -]?[A-Da-d](?![\w-])")),
    (4, re.compile(r"(?<![\w.-])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![\w-])")),
    (5, re.compile(r"(?<![\w.-])[A-Z]{1,3} ?[0-9]{6,9}(?![\w-])")),
    (6, re.compile(r"(?<![\w.+-])[12] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[0-9]{3} ?[0-9]{3}(?: ?[0-9]{2})?(?![\w-])")),
    (7, re.compile(r"(?<![\w.+-])[0-9]{2} ?[0-9]{3} ?[0-9]{3} ?[0-9]{3}(?![\w-])|(?<![\w.+-])[0-9]{9}(?![\w-])")),
]
# Numbers of letters and digits mixed, as German, French or Italian cards and passports have; the sign looked for first is a plain
# class, so that the scan of a whole text is fast.
_MIXED_IDS = [
    (8, re.compile(r"[A-Z](?<![\w.+-][A-Z])(?=[A-Z0-9]{8,9}(?![\w-]))[A-Z]*\d[A-Z0-9]*")),
    (9, re.compile(r"[0-9](?<![\w.+-].)[0-9][A-Z]{2}[0-9]{5}(?![\w-])")),
]
# Capital and small letters of the Latin script.
_U = "A-Z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isupper())
_L = "a-z" + "".join(c for c in map(chr, range(0xC0, 0x250)) if c.islower())
_CAP = rf"(?:(?:Mc|Mac|O['’]|D['’]|d['’]|L['’])?[{_U}][{_L}'’]*[{_L}](?:-(?:[{_U}][{_L}'’]+))*)"
_UP = rf"(?:[{_U}]{{3,}}(?:-[{_U}]{{2,}})*)"
_INIT = rf"(?:[{_U}]\.(?:[ -]?[{_U}]\.)*)"
_TOKEN = rf"(?:{_INIT}|{_CAP}(?!\w)|{_UP}(?!\w))"
_RUN = re.compile(rf"(?<![\w@/.'’-])(?:(?:{PARTICLES})[ ]){{0,3}}{_TOKEN}(?:,?[ ](?:(?:{PARTICLES})[ ]){{0,3}}{_TOKEN})+(?![\w@(]|[/_][\w])")
_FIRST = re.compile(rf"[{_U}][\w.'’-]*,?[ ](?:[^\W\d_]+[ ]){{0,3}}(?:[Dd]['’])?[{_U}]")
_BEFORE_FIRST = re.compile(rf"(?:(?:{PARTICLES})[ ]){{1,3}}\Z|d['’]\Z")
_PIECE = re.compile(rf"(,?)[ ]?((?:(?:{PARTICLES})[ ]){{0,3}})({_TOKEN})")

_TOWN = rf"[{_U}][{_L}'’]+(?:(?:-|[ ](?:(?:am|an|der|de|del|la|las|los|sur|sous|les|le|upon|on|in|im|bei|ob|y)[ ]){{0,2}})[{_U}][{_L}'’]+){{0,3}}"
_WORDS = rf"(?:(?:[{_U}][\w'’-]*|de|del|la|las|los|el|le|les|du|des|d['’]|aux|au|à|y|et|der|den|am|an|zur|zum)[ ]?){{1,6}}"
_ZIP = r"(?:\d{5}(?:-\d{4})?|\d{4}[ ]?[A-Z]{2}|[A-Z]{1,2}\d[A-Z\d]?[ ]?\d[A-Z]{2})"
_US_WAY = r"(?:St|Street|Rd|Road|Ln|Lane|Ave|Avenue|Close|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Blvd|Boulevard|Terrace|Crescent|Hill|Row|Gardens|Parkway|Walk|Mews|Grove)\.?"
_UNIT = r"(?:,?[ ](?:Apt|Apartment|Flat|Unit|Suite|Ste|Room|Floor|No|#)\.?[ ]?[\w-]{1,5})?"
_ES_WAY = r"(?:Calle|C/|C\.|Cl\.|Avda\.?|Av\.|Avenida|Plaza|Pza\.?|Pl\.|Paseo|Pº|Camino|Cno\.|Carrer|Carretera|Ctra\.|Ronda|Travesía|Rúa|Rambla|Glorieta)"
_FR_WAY = r"(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|allées|quai|cours|route|square|passage|Rue|Avenue|Boulevard|Place|Chemin|Impasse|Allée|Quai)"
_DE_WAY = rf"(?:[{_U}][{_L}]+[ ])?[{_U}][{_L}-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|ring|ufer|damm|steig)|(?:[{_U}][{_L}]+[ ]){{1,2}}(?:Straße|Strasse|Str\.|Weg|Gasse|Platz|Allee|Ring|Ufer|Damm|Steig)|(?:Am|An[ ]der|Im|In[ ]der|Auf[ ]de[mr]|Zum|Zur|Unter[ ]den)[ ][{_U}][{_L}]+"
_BOX = r"(?:P\.?[ ]?O\.?[ ]?Box|Post Office Box|Apartado(?: de [Cc]orreos)?|Apdo\.?(?: de [Cc]orreos)?|Postfach|Boîte [Pp]ostale|B\.?P\.?|Casilla)"
_ADDRESSES = [
    (0, rf"\d{{1,5}}[A-Za-z]?[ ](?:[{_U}][{_L}'’-]+[ ]){{1,4}}{_US_WAY}{_UNIT}"),
    (1, rf"{_ES_WAY}[ ]?{_WORDS},?[ ](?:n\.?º[ ]?|núm\.?[ ]?)?\d{{1,4}}(?:[ ]bis)?(?:,[ ](?:piso[ ])?\d{{1,2}}[.]?[ºª°]?(?:[ ]?[A-Z]|[ ](?:izq|dcha|izda)\.?)?)?"),
    (2, rf"\d{{1,4}}(?:[ ](?:bis|ter))?,?[ ]{_FR_WAY}[ ]{_WORDS}"),
    (3, rf"(?:{_DE_WAY})[ ]\d{{1,4}}[ ]?[a-z]?"),
    (4, rf"{_BOX}[ ](?:n\.?º[ ]?)?\d{{1,6}}"),
]
_END = re.compile(rf",?[ ](?:(?:{_ZIP}|(?:[A-Z]{{1,2}}-)?[0-9]{{4,5}}),?[ ])?(?P<town>{_TOWN})(?:,?[ ](?:[A-Z]{{2}}[ ](?=\d))?(?P<zip>{_ZIP})(?!\w))?|,?[ ](?P<only>{_ZIP})(?!\w)")
# Per form that begins with a word, what a text with such an address holds; a text with none of it need not be looked through.
_HINTS = {
    1: ["Calle", "C/", "C.", "Cl.", "Avda", "Av.", "Avenida", "Plaza", "Pza", "Pl.", "Paseo", "Pº", "Camino", "Cno", "Carre", "Ctra", "Ronda", "Travesía", "Rúa", "Rambla", "Glorieta"],
    3: ["Am ", "An der ", "Im ", "In der ", "Auf de", "Zum ", "Zur ", "Unter den "] + [w for e in ("straße", "strasse", "str.", "weg", "gasse", "platz", "allee", "ring", "ufer", "damm", "steig") for w in (f"{e} ", f"{e.capitalize()} ")],
    4: ["Box ", "Apartado", "Apdo", "Postfach", "ostale", "B.P", "BP", "Casilla"],
}
_STREETS = [(form, re.compile(rf"(?<![\w/-])(?:{p})(?=,|[ ])")) for form, p in _ADDRESSES]
_NUMBER = re.compile(r"[0-9](?<![\w/-].)[0-9]{0,4}(?:[A-Za-z]|[ ](?:bis|ter))?,?[ ][A-Za-zÀ-ÿ]")


def emails(text: str) -> Iterator[tuple[int, int, int]]:
    if "@" in text:
        for m in _PLAIN_MAIL.finditer(text):
            yield m.start(), len(m.group().rstrip(".'-")) + m.start(), 0
    at = 0
    for core in _VEIL_CORE.finditer(text):
        # A bracket with a blank on either side is the most that can stand before it.
        tries = (_VEIL.match(text, i) for i in range(max(at, core.start() - 3), core.start()))
        m = next((t for t in tries if t and t.end() > core.start()), None)
        if m is None:
            continue
        at = m.end()
        first = text.rfind("\n", 0, m.start()) + 1
        local = _VEILED_LOCAL.search(text[first : m.start()])
        if local:
            yield first + local.start(), _VEILED_DOMAIN.match(text, m.end()).end(), 1


def _cued(text: str, a: int, b: int) -> bool:
    """Whether a cue for a phone is on the line of a span."""
    start, end = text.rfind("\n", 0, a) + 1, text.find("\n", b)
    return any(w.lower() in _PHONE_CUES for w in _CUE_WORD.findall(text[start : len(text) if end < 0 else end]))


def phones(text: str) -> Iterator[tuple[int, int, int]]:
    for m in _PHONE.finditer(text):
        found = m.group()
        if 7 <= sum(map(str.isdigit, found)) <= 16 and not (_DECIMAL.fullmatch(found) and not _cued(text, m.start(), m.end())):
            yield m.start(), m.end(), 0


_SIX_DIGITS = re.compile(r"[0-9](?:[ .-]?[0-9]){5}")


def _lines_with(pattern: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Start and end of the lines in which the pattern is found."""
    at = 0
    while m := pattern.search(text, at):
        start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        end = len(text) if end < 0 else end
        yield start, end
        at = end


def ids(text: str) -> Iterator[tuple[int, int, int]]:
    """The forms of _IDS have six digits at least; only lines with as many are looked through for them. Mixed numbers may have a
    single one and are looked for everywhere."""
    for start, end in _lines_with(_SIX_DIGITS, text):
        for form, p in _IDS:
            for m in p.finditer(text, start, end):
                yield m.start(), m.end(), form
    for form, p in _MIXED_IDS:
        for m in p.finditer(text):
            yield m.start(), m.end(), form


def _holds(text: str, words: list[str]) -> bool:
    for w in words:
        if w in text:
            return True
    return False


def addresses(text: str) -> Iterator[tuple[int, int, int]]:
    """A street or box with what ends it; for a town of several words, each shorter town as well."""
    numbers = [m.start() for m in _NUMBER.finditer(text)]
    for form, p in _STREETS:
        if form in _HINTS:
            if not _holds(text, _HINTS[form]):
                continue
            found = p.finditer(text)
        else:
            # Forms that begin with the number are tried at numbers only.
            found = filter(None, (p.match(text, n) for n in numbers))
        for m in found:
            end = _END.match(text, m.end())
            if not end:
                continue
            if end["only"]:
                yield m.start(), end.end(), form
                continue
            stops = {end.end()}
            if end["zip"] is None:
                town = end["town"]
                stops |= {end.start("town") + i for i, c in enumerate(town) if c in " -"}
            for stop in stops:
                yield m.start(), stop, form


def _runs(text: str) -> Iterator[re.Match]:
    """Matches of _RUN, tried only where a capitalised word is followed by another one, particles aside."""
    at = 0
    while m := _FIRST.search(text, at):
        lead = _BEFORE_FIRST.search(text[max(at, m.start() - 12) : m.start()])
        run = (_RUN.match(text, m.start() - len(lead.group())) if lead else None) or _RUN.match(text, m.start())
        if run:
            yield run
            at = max(run.end(), m.start() + 1)
        else:
            # On with the next word: nothing can begin within this one.
            at = m.start() + 1
            while at < len(text) and (text[at].isalnum() or text[at] in ".'’-"):
                at += 1


def names(text: str) -> Iterator[tuple[int, int, int]]:
    """Every stretch of two to four capitalised words of a run, and Family, Given where a comma stands between."""
    for run in _runs(text):
        pieces = [(m.start(3), m.end(3), m.start(2) if m.group(2) else m.start(3), bool(m.group(1))) for m in _PIECE.finditer(text, run.start(), run.end())]
        for i in range(len(pieces)):
            commas = 0
            for j in range(i + 1, min(len(pieces), i + 4)):
                commas += pieces[j][3]
                if commas > 1:
                    break
                if _INITIAL.match(text, pieces[j][0], pieces[j][1]) and not commas:
                    continue
                yield pieces[i][0], pieces[j][1], 1 if commas else 0
                if commas and pieces[i][2] < pieces[i][0]:
                    yield pieces[i][2], pieces[j][1], 1


_INITIAL = re.compile(rf"[{_U}]\.")
GENERATORS: dict[str, Callable[[str], Iterator[tuple[int, int, int]]]] = {"email": emails, "phone": phones, "id": ids, "address": addresses, "name": names}

# ---- how often words occur in lower case ----------------------------------------------------------------------------

TABLE_BITS = 20
_LOWER = re.compile(r"(?<![\w.@+/'’-])[a-zß-öø-ÿ]{3,}(?![\w@+/-]|\.\w|[ ]\[?(?:at|dot|arroba)\b)")


def slots(word: str) -> tuple[int, int]:
    b = word.encode()
    return zlib.crc32(b) & ((1 << TABLE_BITS) - 1), (1 << TABLE_BITS) + (zlib.crc32(b, 0x5BD1E995) >> 5 & ((1 << TABLE_BITS) - 1))


class Vocabulary:
    """Counts of lower-case words in two hashed tables of fixed size; a word's count is the lesser of its two slots."""

    def __init__(self, counts: np.ndarray, total: int):
        self.counts, self.total, self.memory = counts, max(1, total), {}

    def per_million(self, word: str) -> float:
        out = self.memory.get(word)
        if out is None:
            a, b = slots(word)
            out = float(np.log1p(min(self.counts[a], self.counts[b]) * 1e6 / self.total))
            if len(self.memory) < 200_000:
                self.memory[word] = out
        return out


def check_digit(number: str) -> str:
    """Last digit that machine-readable documents put behind a number (ICAO 9303)."""
    return str(sum(int(c, 36) * (7, 3, 1)[i % 3] for i, c in enumerate(number)) % 10)


# ---- features -------------------------------------------------------------------------------------------------------

_TOKENS = re.compile(r"[\w.'’-]*\w[.]?|[^\w\s]")
_CUE_SETS = {k: set(v.split()) for k, v in CUES.items()}
_CUE_SETS_AFTER = {k: set(v.split()) for k, v in CUES_AFTER.items()}
_CLASSES = {c: i for i, cs in enumerate(["\n", " \t", "\"'`“”«»", "=", ":", "<>", "()[]{}", ",;", ".!?", "/\\", "-_*#"], 1) for c in cs}


def _char_class(text: str, at: int) -> int:
    if at < 0 or at >= len(text):
        return 1
    return _CLASSES.get(text[at], 12 if text[at].isalnum() else 0)


def _words(part: str) -> list[str]:
    out = []
    for w in _TOKENS.findall(part):
        w = w.lower()
        out.append(w)
        if w[-1] == "." and len(w) > 1:
            out[-1] = w[:-1]
            out.append(".")
    return out


def _nearest(words: list[str], lexicon: set[str]) -> int:
    """5 for a word of the lexicon next to the span, less the farther away, 0 for none; a full stop between ends the search."""
    far = 0
    for w in words:
        if w in (".", "!", "?"):
            if far:
                return 0
            continue
        if w in lexicon or ("_" in w and any(x in lexicon for x in w.split("_"))):
            return max(1, 5 - far)
        if w[0].isalnum():
            far += 1
        if far > 5:
            break
    return 0


def _own_features(kind: str, text: str, a: int, b: int, form: int, vocabulary: Vocabulary) -> list[float]:
    s = text[a:b]
    digits = "".join(c for c in s if c.isdigit())
    if kind == "email":
        domain = re.split(r"@|\bat\b|\barroba\b", s)[-1].strip(" ])}>")
        last = re.split(r"[.\s\[\](){}]+", domain.rstrip(" ])}>"))[-1].lower()
        local = re.split(r"@|[\[({<\s]\s?(?:at|arroba)", s)[0]
        return [form, float(last.isalpha()), float(last in FILE_ENDINGS), float(domain[:1].isdigit()), float(local in ("git", "hg", "svn", "npm", "user", "root", "ssh")), float(text[b : b + 1] == ":" and text[b + 1 : b + 2].isalnum()), float(any(c.isdigit() for c in domain)), s.count(" ")]
    if kind == "phone":
        plus, double0 = s.startswith(("+", "(+")), s.startswith("00")
        national = digits[2:] if double0 else digits
        known = max((len(c) for c in DIAL_CODES if national.startswith(c)), default=0) if plus or double0 else 0
        groups = [len(g) for g in re.findall(r"\d+", s)]
        return [len(digits), float(plus), float(double0), known, float(digits.startswith("0")), len(groups), groups[0], groups[-1], max(groups), float("(" in s), float("/" in s), float("." in s), float("-" in s or "‑" in s or "–" in s), float("‑" in s), float(" " in s),
                float(len(digits) == 10 and digits[0] in "23456789" and groups in ([3, 3, 4], [10])), float(re.match(r"20\d\d[- ]", s) is not None), float(len(digits) in (9, 10, 11, 12, 13)), float(s.count(".") == 3 and len(groups) == 4)]
    if kind == "id":
        letters = "".join(c for c in s if c.isalpha())
        valid = 0.0
        if form in (0, 1):
            valid = float(DNI_LETTERS[int(digits) % 23] == letters.upper()[-1:])
        elif form == 2:
            number = "XYZ".find(s[0].upper())
            valid = float(DNI_LETTERS[int(f"{number}{digits}") % 23] == letters.upper()[-1:])
        elif form == 8 and len(s) == 10:
            valid = float(check_digit(s[:9]) == s[9])
        return [form, len(s), len(digits), len(letters), valid, float(letters.isupper()), float(" " in s), float("-" in s), float("." in s), float(s[:1].isalpha())]
    tokens = [w for w in re.findall(r"[\w'’.-]+", s) if w[0].isalpha()]
    right = re.match(rf"[ ,]+({_TOKEN})", text[b : b + 40])
    left = re.search(rf"({_TOKEN})[ ]$", text[max(0, a - 40) : a])
    strange = [vocabulary.per_million(w.lower().split("-")[-1]) for w in tokens if w[0].isupper()]
    common = [not _INITIAL.fullmatch(w) and w.lower().rstrip(".") in COMMON and not (i and w.lower() in _PARTICLE_SET) for i, w in enumerate(w for w in tokens if w[0].isupper())]
    next_common = float(bool(right) and right.group(1).lower().rstrip(".") in COMMON)
    next_rare = float(bool(right) and not next_common and vocabulary.per_million(right.group(1).lower()) < 1.5)
    previous_common = float(bool(left) and left.group(1).lower().rstrip(".") in COMMON | TITLES)
    if kind == "address":
        last = tokens[-1].lower() if tokens else ""
        return [form, float(re.search(r"\d{5}", s) is not None), float(bool(right)), next_common, next_rare, float(last in COMMON), vocabulary.per_million(last), float(s[-1].isdigit()), s.count(","), float(text[b : b + 1] in "-"), float(bool(re.match(r" \w+[.:]", text[b : b + 30])))]
    initials = sum(len(w) <= 3 and w.endswith(".") for w in tokens)
    full = [w for w in tokens if w[0].isupper() and not w.endswith(".")]
    first = tokens[0].lower().rstrip(".")
    return [form, len([w for w in tokens if w[0].isupper()]), initials, len(full), float(tokens[0].endswith(".")), float(any(w[0].islower() for w in tokens)), float(s.isupper()), float(any(common)), float(common[0]), float(common[-1]), max(strange), min(strange), strange[0], strange[-1],
            float(first in TITLES), float(bool(left)), previous_common, vocabulary.per_million(left.group(1).lower()) if left else -1.0, float(bool(right)), next_common, next_rare, float("-" in s), float(any(w.lower() in AGAINST for w in tokens)), float(sum(w.lower() in NO_PERSON for w in tokens)), float(first in GIVEN), float(any(w.lower() in GIVEN for w in tokens)), float(text[b : b + 1] == ","), float(text[b : b + 1] == ":"), float(any(w.isupper() and len(w) > 2 for w in full) and not s.isupper())]


def _sides(text: str, a: int, b: int, memory: dict) -> tuple:
    """What surrounds a span: words before it, nearest first, and behind it, words of the line above where none is before it, whether it
    stands alone on its line, and whether it begins or ends the line. Spans with a common border share the work."""
    left, right = memory.get((a, "<")), memory.get((b, ">"))
    if left is None:
        start = text.rfind("\n", 0, a) + 1
        before = text[max(start, a - BEFORE) : a]
        words = _words(before)[::-1]
        earlier = _words(text[max(0, start - 40) : max(0, start - 1)])[::-1] if not before.strip(" \t#/*-") else []
        left = memory[a, "<"] = (words, earlier, not any(w[0].isalnum() for w in words), float(a == start), float(before.rstrip(" \t\"'").endswith(("=", ":"))))
    if right is None:
        end = text.find("\n", b)
        end = len(text) if end < 0 else end
        words = _words(text[b : min(end, b + AFTER)])
        right = memory[b, ">"] = (words, not any(w[0].isalnum() for w in words), float(b == end))
    return left, right


def features(kind: str, text: str, a: int, b: int, form: int, vocabulary: Vocabulary, memory: dict | None = None) -> list[float]:
    """The span's own form, then its surroundings on the line: cues before and after, signs around, place on the line."""
    (before, earlier, bare_left, at_start, assigned), (after, bare_right, at_end) = _sides(text, a, b, {} if memory is None else memory)
    around = [
        _nearest(before, _CUE_SETS[kind]), _nearest(after, _CUE_SETS_AFTER[kind]), _nearest(before, AGAINST), _nearest(after, AGAINST), _nearest(earlier, _CUE_SETS[kind]),
        _char_class(text, a - 1), _char_class(text, b), at_start, at_end, float(bare_left and bare_right), assigned,
    ]
    return around + _own_features(kind, text, a, b, form, vocabulary)


def candidates(text: str, vocabulary: Vocabulary, kinds: tuple[str, ...] = KINDS) -> Iterator[tuple[str, int, int, list[float]]]:
    memory: dict = {}
    for kind in kinds:
        seen = set()
        for a, b, form in GENERATORS[kind](text):
            if (a, b) not in seen:
                seen.add((a, b))
                yield kind, a, b, features(kind, text, a, b, form, vocabulary, memory)
