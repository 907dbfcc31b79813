"""Labelled lines for fitting the redaction models. They are made up from carrier sentences, number rules, syllables and frequent
names, so every label is known. The sentences were written for this purpose; none is taken from the tables, and a test sees to it that no
carrier but ordinary labels stands in them. Nobody real is meant."""

from __future__ import annotations

import random
import re
import zlib

from depweft.llm.pii_spans import AGAINST, COMMON, DNI_LETTERS, GIVEN, check_digit

_STARTS = "Bar Cel Dor Fen Gal Hol Iv Jas Kel Lor Mav Nim Or Pol Quen Ras Sil Tor Ul Ver Wil Xan Yor Zel Ál Ös Üm Ka Ro Mi".split()
_MIDS = "a an el em i il o or u ul en ar é ö in as".split()
_ENDS = "bek dal dez ford gan hoff ier ken lez mont nov oux quist rell ric sen ska son tell ti va vez witz yan zen ñez rés bö".split()
_TOWN_ENDS = "bury dorf ford heim mora mouth nia stadt thal ton val ville wick zell".split()
#: Frequent family names, some of which are words as well.
_FAMILIES = (
    "Smith Jones Taylor Brown Williams Wilson Johnson Davies Patel Wright Walker White Green Hall Wood Clarke Baker Hill Moore King Young Cook Bell Carter Parker Stone Fox Reed Cooper Rose Long Gray Price Woods "
    "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Martín Jiménez Ruiz Hernández Díaz Moreno Álvarez Romero Navarro Torres Iglesias Cano Prieto Blanco Rubio Calvo Vidal Peña Flores Cabrera Reyes "
    "Bernard Dubois Durand Leroy Moreau Simon Laurent Lefebvre Roux Fournier Girard Bonnet Dupont Lambert Fontaine Rousseau Vincent Muller Faure Mercier Blanc Guérin Boyer Garnier Chevalier Legrand Gauthier Perrin Morel "
    "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hofmann Lange Krause Lehmann Köhler Maier Huber Vogel Kowalski Nowak Rossi Silva Santos Nguyen Kim Chen Singh Ivanov Haddad Yilmaz"
).split()
_TOWNS = "London Leeds Oxford Boston Austin Denver Seattle Madrid Sevilla Bilbao Zaragoza Valencia Paris Lyon Nantes Lille Bordeaux Berlin Hamburg München Köln Dresden Wien Zürich Basel Lisboa Torino".split()
_PLAIN = (
    "It rained on {n} of {n} days. The train leaves at {n}. We bought {n} apples and a loaf of bread. Nobody came to the second meeting. Hay que cambiar la bombilla del pasillo. Quedan {n} sillas libres en la sala. Il faut arroser les plantes du balcon. "
    "La réunion a duré {n} minutes. Der Aufzug ist seit {n} Tagen kaputt. Bitte das Fenster schließen. The soup needs more salt. Turn left after the church. El perro duerme en el sofá. Chapter {n} is the longest. Version {n}.{n} came out last week"
).split(". ")

_CARRIERS = {
    "name": [
        "Minutes taken by {x}.", "Approved by {x} on Monday.", "I spoke with {x} about the rent.", "{x} will give the opening talk.", "Please forward this to {x}.", "The drawing from {x} is better.", "Interview with {x}", "Speaker: {x}", "Manager: {x}", "Assignee: {x}", "@author {x}", "Written by {x}", "Sincerely,\n{x}", "Yours,\n{x}", "Kind regards\n{x}",
        "Mrs {x} cancelled the appointment.", "Ms. {x} is on leave", "Mr {x} paid in cash.", "Dr {x} will see you now.", "Prof. {x} teaches on Fridays.", "{x} replied:", "{x} joined the channel", "My name is {x} and I need help.", "I am {x}.", "This is {x} from accounting.", "Hi {x},", "Attn: {x}", "Customer {x} wants a refund.", "Our colleague {x} retired.", "tell {x} that lunch is ready", "{x} and I went home.",
        "{x} told us to wait.", "has anyone seen {x} today?", "a letter for {x}", "{x} called about the heating", "in memory of {x}", "Copyright (c) 2019 {x}", "name = '{x}'", '"name": "{x}"', "user: {x}", "<dd>{x}</dd>", "# TODO({x}): check the units", "{x}", "{x}", "{x}:", "- {x}", "{x} was late again.", "together with {x} and the others", "{x} answered the phone.", "We hired {x} in spring.",
        "Firmado por {x}", "Atendido por {x} en recepción.", "El coche de {x} no arranca.", "Le escribe {x}.", "Me llamo {x}.", "Responsable: {x}", "Cliente: {x}", "Autora: {x}", "Un saludo,\n{x}", "Hablé con {x} por la mañana.", "{x} dijo que vendría.", "Estimado {x}:", "don {x} firmó el contrato", "doña {x} vive sola", "el señor {x} no está", "la señora {x} llega a las diez", "{x} avisó a todos.",
        "Rédigé par {x}", "Bonjour {x},", "Madame {x} est absente.", "Monsieur {x} a téléphoné.", "{x} a répondu hier.", "Bien à vous,\n{x}", "Responsable : {x}", "Je m'appelle {x}.", "un message de {x}", "avec {x} et son équipe", "selon {x}, le train est parti", "merci à {x} d'être venue",
        "Mit freundlichen Grüßen\n{x}", "Herr {x} ist im Urlaub.", "Sachbearbeiterin: {x}", "Ansprechpartner: {x}", "Ich heiße {x}.", "{x} hat angerufen.", "Liebe {x},", "bearbeitet von {x}", "Viele Grüße, {x}", "Frau {x} kommt um neun.", "laut {x} stimmt das", "{x} bat um Geduld.", "gracias, {x}", "by {x}", "from {x}", "owner={x}", "reviewer: {x}", "according to {x}, it was raining",
    ],
    "email": [
        "Questions? {x}", "Send the form to {x} before Friday.", "my address is {x}", "user={x}", '"email": "{x}"', "From: {x}", "To: {x}", "Reply-To: {x}", "Correo electrónico: {x}", "puede responder a {x}", "mi correo: {x}", "nous joindre : {x}", "adresse électronique {x}", "E-Mail-Adresse: {x}", "erreichbar unter {x}", "<{x}>", "({x})", "{x}", "{x}", "mail me at {x}, thanks", "<a href=\"mailto:{x}\">", "# {x}",
        "invoices go to {x}.", "signed up as {x} yesterday", "bitte an {x} senden", "author_email='{x}'", "{x} bounced", "write us: {x}", "por correo a {x}", "'{x}',", "pour toute question {x}", "[{x}]", "account {x} is locked", "you can find me under {x} until noon", "{x} is not read any more", "{x} was wrong", "{t} {x} {t}", "{T}: {x}", "{t}={x}", "the {t} {x} is {t}", "or {x} at night", "my old one, {x}, is closed",
    ],
    "phone": [
        "Phone: {x}", "my number is {x}", "Cell {x}", "call me at {x}", "Office: {x}", "T: {x}", "Fax: {x}", "WhatsApp {x}", "Hotline {x}", "número de contacto {x}", "Tlf. {x}", "mi teléfono es el {x}", "appelez le {x}", "numéro : {x}", "Telefonnummer {x}", "telefonisch unter {x}", "Mobil: {x}", "tel:{x}", '"phone": "{x}"', "dial {x} now", "{x}", "{x}", "text {x} for details", "In an emergency: {x}.", "reach the doctor on {x} at night",
        "front desk, {x}, day and night", "mobile={x}", "cel. {x}", "o al {x} por la tarde", "ou au {x} le soir", "oder {x} ab neun", "({x})", "The switchboard has {x}.", "my new phone, {x}, works", "contact = '{x}'", "the number is {x}.", "their line {x} was busy", "{T}: {x}", "{t}={x}", "{t} {x} {t}", "the {t} of the house, {x}, rings", "under {x} all day",
    ],
    "id": [
        "Passport number: {x}", "SSN: {x}", "Social Security Number {x}", "my national insurance number is {x}", "NINO {x}", "tax number {x}", "ID number {x}", "identity card no {x}", "Documento de identidad: {x}", "D.N.I. {x}", "titular con NIE {x}", "número de la seguridad social {x}", "pasaporte nº {x}", "carte d'identité n° {x}", "passeport n° {x}", "n° de sécurité sociale : {x}", "Personalausweisnummer {x}", "Reisepassnummer: {x}",
        "Sozialversicherungsnummer {x}", "Steuer-ID {x}", "Aufenthaltstitel {x}", "residence card {x}", "{x}", "the applicant gave {x} as identity number", "passport={x}", "dni = '{x}'", '"ssn": "{x}"', "holder of passport {x} since May", "con documento {x} en vigor", "NIF: {x}", "nif {x}", "mein Ausweis {x} ist abgelaufen", "titulaire du passeport {x}", "the taxpayer {x} moved", "ni number: {x}", "insurance no: {x}", "su NIF, {x}, no figura", "The scanned identity card reads {x}.",
        "id_card: {x}", "Pasaporte: {x}", "documento nacional {x}", "Passport {x}", "Permit {x} for residence", "{T}: {x}", "{t} = '{x}'", "{x} was printed on her card", "identity {x} {t}",
    ],
    "address": [
        "Deliveries go to {x}.", "Residence: {x}", "Billing address: {x}", "We are based at {x}.", "she resides at {x} now", "Domicilio: {x}", "reside en {x}", "enviar a {x}", "el paquete va a {x}.", "Siège social : {x}", "demeurant {x}", "à livrer au {x}", "Lieferadresse: {x}", "wohnhaft in {x}", "unser Büro: {x}", '"address": "{x}"', "street='{x}'", "{x}", "{x}", "({x})", "The shop at {x} is closed.", "come to {x}, second floor", "{x} is our new home",
        "home: {x}", "vivimos en {x}", "nuestra sede, {x}, abre a las nueve", "nous habitons {x}", "wir wohnen {x}", "Postanschrift: {x}", "post it to {x} by Friday", "the parcel for {x} came back", "venue: {x}", "location = {x}", "She lives at {x}, top bell.", "{T}: {x}", "{T} : {x}", "{t}={x}", "{T} {T}: {x}", "{t} {x} {t}", "the {t} is at {x} now", "{t}: {x}",
    ],
}
_LEADS = ["", "", "", "", "# ", "// ", "- ", "* ", "<p>", "[09:41] ana> ", "/* ", "<!-- ", "Note: ", "+    ", '    """', "> ", "1. "]
_LITTLE = "the a was is in on for and again today el la está en de por fue para le est dans pour der das ist war mit".split()
#: Names of organisations, products, places and titles are put together from these.
_ORG_HEADS = "United National European Royal Central Global First New Great Open Free General North South American International Western Grand".split()
_ORG_TAILS = "Nations Union University Institute Foundation Bank Airlines Group Systems Software Studio Cloud Labs Press Museum Council Ministry Office Library Times Park Station Airport Hospital School Market Services Partners Theatre".split()
_PRODUCTS = ["Visual Basic", "Home Assistant", "Google Maps", "Red Hat", "Windows Server", "Apache Kafka", "Internet Explorer", "Power Point", "Open Office", "Android Auto", "Microsoft Word", "Oracle Database", "Amazon Prime", "Black Friday", "New York", "San Francisco", "Los Angeles", "South Africa", "Buenos Aires", "Great Britain", "North Sea", "Saint Helena", "Monday Morning", "Happy Birthday", "Good Friday", "Merry Christmas"]
_FALSE = [
    "{T} {T} opens on Sunday.", "The {T} {T} was built long ago.", "We use {T} {T} and {T} {T} for this.", "{T} {T}", "# {T} {T}", "## {T} and {T}", "{T} {T} {T}", "{T} of {T} {T}", "See {T} {T} for more.", "Introduction to {T} {T}", "About {T} {T}", "A {T} {T} in the garden", "New in {T} {T}", "Install {T} {T} first.", "class {T} extends {T}", "{T} {T} is a {t}.", "{T} {T} became {T} {T} last year.",
    "{O} said no.", "The {O} replied.", "I work for {O}.", "a letter from {O}", "{O}", "{P}", "We met in {P}.", "{P} is slow today.", "by {P}", "according to {O}", "from {P} with love", "the {P} of {P}", "{O} and {O}", "thanks to {O}", "{P} told us nothing", "Copyright (c) 2019 The {T} {T} Contributors", "by the {T} {T} team", "{P} 2019", "at the {O} in {P}", "Contact {O}", "Dear {O} Team,",
    "{A} {V}", "{A} {V}", "{A} {V} {t} the {t}", "{A}: {V}", "{A} no. {V}", "the {A} {V} {t}", "{A} {V} restarts", "{B} {V} {t}", "{B} {V}",
    "Hello, Call later.", "Hi, Please wait.", "Hola, Nos vemos.", "Bonjour, Merci beaucoup.", "Hallo, Bitte warten.", "{F}, Please wait.", "Good evening, According to plan.", "{T}: {T} {T}", "{t}: {T} {T}",
    "{W} {F} {t} {t}.", "{W} {F} {n} {t}", "{W} {F}", "{W} {F} ist {t}.", "{t}. {W} {F} und {W} {F} {t}", "{W} {T} {t} the {t}.", "{W} {W} {t}", "{W}, {W} {t}", "{W}, {F} {t}", "{W} {W}", "{W} {T} {T} {t}", "{W}, {T} {T}",
    "{F} said hello.", "Tell {F}.", "Guten Abend,", "Good evening,", "Buenas noches,", "Bonne journée,", "Happy New Year", "To Whom It May Concern",
    "git@{D}:{t}/{t}.git", "git fetch ssh://git@{D}/{t}.git", "scp {t}@{D}:/tmp/{t} .", "{t}@{n}.{n}.{n}", "yarn add {t}@{n}.{n}", "npm i @{t}/{t}@^{n}.0.0", "logo@2x.png and logo@3x.png", "{t}_{t}@2x.jpg", "@{t}.setter", "look at it dot by dot", "we meet at {t} or at {t}", "arrive at home dot", "{t}@{t}",
    "run {n} of +{n} {d3} {d7}", "ISBN 978-{d1}-{d2}-{d6}-{d1}", "ISBN 978{d9}{d1}", "EAN {d8}{d5}", "IP 10.{n}.{n}.{n}", "{n}.{n}.{n}.{n}:{d4}", "2021-0{d1}-1{d1} 10:2{d1}:3{d1}", "2021-0{d1}-1{d1}, {d6} rows", "20{d2}-{d3}-{d4}", "0x{h8}, 0x{h8}", "{h8}-{h4}-{h4}-{h4}-{h8}{h4}", "sha1 {h8}{h8}{h8}", "checksum {d9}{d3}", "fingerprint {d9}{d3} of the disk", "the hash {d9}{d3} differs", "id {d9}{d3} of the commit", "l'empreinte numérique {d9}{d3}", "huella {d9}{d3}", "die Prüfsumme {d9}{d3} stimmt",
    "{d2}.{d6}, {d2}.{d6}", "[{d2}.{d6}, -{d1}.{d6}]", "{d3}, {d3}, {d3}, {d3}", "{d4}-{d4}", "between 1{d3} and 1{d3}", "pages {d3}-{d3}", "$ {d3},{d3}.{d2}", "{d1},{d3},{d3}", "total {d7}", "1{d9}", "size {d8} bytes", "offset {d8}", "unix time 16{d8}", "pid {d5}", "port {d5}", "{d2}-{d2}-{d3} as separators", "wait {d2}-{d2}-{d3} ms", "build {d3}-{d2}-{d3}",
    "order {d3} {d3} {d4} was sent", "order no {d2} {d3} {d4}", "Pedido {d3} {d3} {d4} entregado", "commande {d3} {d2} {d4}", "Bestellung {d3} {d3} {d4} ist da", "ticket {d3}-{d4}", "Case {d4}-{d3}-{d4} was closed", "Job {d3} {d7} failed", "task +{n} {d3} {d6} ended", "lot {d3} {d3} {d4}", "lote {d3} {d3} {d4}",
    "Spare part {d8}{L} has shipped", "component {d8}{L}", "article {d8}-{L}", "Artikel {d8}{L} ist aus", "pieza {d8}{L} rota", "pièce {d8}{L} cassée", "model {L}{L}{d7}", "serial number {L}{L}{d7}", "SN {L}{L}{d6}", "SN {d3}-{d2}-{d4}", "batch no {d3}-{d2}-{d4}", "lot {d3}-{d2}-{d4} expired", "lote {d3}-{d2}-{d4} caducado", "item {d3} {d2} {d4} on the list", "Rechnung {L}{L}{d6}", "invoice no {L}{d8}", "factura {L}-{d8}", "version {L}{d7}", "serie {L}{L} {d6}",
    "component {M}", "spare part {M}", "article {M} sold out", "SN {M}", "batch {M}", "lote {M}", "serie {M}", "item {M} on the list", "order {M}", "tracking {M}", "ticket {M}", "invoice no {M}", "model {M} is noisy", "Artikel {M}", "commit {h8}", "{C} = {n}", "export {C}={n}", "if {C}:", "Teil {M}", "pièce {M}",
    "{n} {T} Street is a film.", "Room {n}, {T} Street View", "{n} {T} Road Signs explained", "the {T} Street View of page {n}", "Figure {n}: {T} Road map", "Calle {T} {T}", "rue {T} et rue {T}", "Plaza {T}, de {n} a {n}", "Chapter {n} {T} Lane Rules", "calle abajo, {n} pasos",
    "/usr/share/{t}/{n}/file.txt", "https://{D}/{t}/{d8}", "see page {n} of the handbook", "DO NOT DISTURB", "READ ME FIRST", "END OF FILE", "ALL RIGHTS RESERVED", "THE {T} {T}",
]


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.topics = [self._word().lower() for _ in range(150)]
        self.given = sorted(GIVEN)
        self.openers = sorted(w.capitalize() for w in COMMON if len(w) > 1)
        self.labels = sorted(w for w in AGAINST if len(w) > 2)

    def _word(self) -> str:
        r = self.r
        if r.random() < 0.3:
            short = r.choice("ABCDEFGHIJKLMNOPRSTUVXYZ") + r.choice("aeioué") + r.choice("bdfklmnrstvz") + r.choice(["", "a", "e", "o", "is", "en", "ar", "ka", "ía", "us", "ert", "ia"])
            return short
        return r.choice(_STARTS) + "".join(r.choice(_MIDS) + r.choice("bcdfglmnprstv") for _ in range(r.randint(0, 1))) + r.choice(_MIDS) + r.choice(_ENDS)

    def name(self) -> str:
        r = self.r
        # Half of the names are frequent ones, the others are made up, so that form and context have to do where no list helps.
        given = "-".join(w.capitalize() for w in r.choice(self.given).split("-")) if r.random() < 0.5 else self._word()
        family = r.choice(_FAMILIES) if r.random() < 0.5 else self._word()
        k = r.random()
        if k < 0.12:
            family = r.choice(["de la", "van", "von", "del", "de", "van der", "di", "Le", "De", "La", "Van", "Mac"]) + " " + family
        elif k < 0.2:
            family += "-" + self._word()
        elif k < 0.35:
            family += " " + self._word()
        k = r.random()
        if k < 0.12:
            return f"{given} {r.choice('ABCDEFGHJKLMNPRSTV')}. {family}"
        if k < 0.2:
            return f"{r.choice('ABCDEFGHJKLMNPRSTV')}. {family}"
        if k < 0.25:
            return f"{r.choice('ABCDEFGH')}. {r.choice('JKLMNPRSTV')}. {family}"
        if k < 0.37:
            return f"{family}, {given}"
        return f"{given} {family}".upper() if k < 0.45 else f"{given} {family}"

    def domain(self) -> str:
        r = self.r
        name, end = r.choice(self.topics), r.choice(["com", "org", "net", "de", "es", "fr", "eu", "io", "co.uk", "edu", "info", "example", "test", "invalid"])
        return r.choice([f"{name}.{end}", f"{name}.{end}", f"mail.{name}.{end}", f"{name}-{r.choice(self.topics)}.{end}", "example.com"])

    def email(self) -> str:
        r = self.r
        a, b = self._word().lower(), self._word().lower()
        local = r.choice([f"{a}.{b}", f"{a}-{b}", f"{a[0]}{b}", f"{b}_{a[:2]}", f"{a}{r.randint(1, 99)}", a, f"{a}.{b}+{r.choice(self.topics)}"])
        domain = self.domain()
        plain = f"{local}@{domain}"
        if r.random() < 0.15:
            plain = plain.title()
        k = r.random()
        if k < 0.62:
            return plain
        at, dot = r.choice([(" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), (" arroba ", " punto "), ("[at]", "."), (" (at) ", "."), (" AT ", " DOT ")])
        full_local = local.replace(".", dot) if r.random() < 0.4 and "[" not in dot else local
        return full_local + at + domain.replace(".", dot)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        d, r = self.digits, self.r
        area, seven = f"{r.randint(2, 9)}{d(2)}", f"{r.randint(2, 9)}{d(2)}{{0}}{d(4)}"
        return r.choice(
            [f"+1 ({area}) {seven.format('-')}", f"+1 ({area}) {seven.format('‑')}", f"+1 {area} {seven.format(' ')}", f"({area}) {seven.format('-')}", f"{area}-{seven.format('-')}", f"{area}.{seven.format('.')}", f"1{area}{seven.format('')}", f"+44 20 {d(4)} {d(4)}", f"0044 20 {d(4)} {d(4)}", f"+44 (0)20 {d(4)} {d(4)}", f"020 {d(4)} {d(4)}", f"07{d(3)} {d(6)}", f"+447{d(9)}", f"+44 7{d(3)} {d(6)}",
             f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33{r.randint(1, 9)}{d(8)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"+49 30 {d(5)} {d(3)}", f"030/{d(8)}", f"+49 1{d(2)} {d(7)}", f"0{d(3)} {d(6)}", f"+61 4{d(2)} {d(3)} {d(3)}", f"04{d(2)} {d(3)} {d(3)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"+34 9{d(8)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}", f"0{d(2)} {d(6)}", f"0{d(3)} {d(5)}", f"0{d(4)} {d(3)} {d(3)}", f"+49 {d(2)} {d(6)} {d(2)}", f"9{d(2)} {d(3)} {d(3)}", f"(0{d(2)}) {d(4)} {d(4)}", f"+52 55 {d(4)} {d(4)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+41 {d(2)} {d(3)} {d(2)} {d(2)}", f"+351 {d(3)} {d(3)} {d(3)}"]
        )

    def id(self) -> str:
        d, r = self.digits, self.r
        number = d(8)
        letter = DNI_LETTERS[int(number) % 23]
        split = f"{number[:2]}{{0}}{number[2:5]}{{0}}{number[5:]}"
        seven = d(7)
        first = r.choice("XYZ")
        nie = DNI_LETTERS[int(f"{'XYZ'.index(first)}{seven}") % 23]
        ni = r.choice("ABCEGHJKLMNPRSTWXYZQ") + r.choice("ABCEGHJKLMNPRSTWXYZQ")
        upper = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
        return r.choice(
            [number + letter, f"{number}-{letter}", number + letter.lower(), split.format(".") + "-" + letter, split.format(" ") + " " + letter, first + seven + nie, f"{first}-{seven}-{nie}", f"{ni} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{ni}{d(6)}{r.choice('ABCD')}",
             f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{upper(2)}{d(7)}", f"{upper(2)}{d(7)}", f"{upper(3)}{d(6)}", f"{upper(1)}{d(8)}", d(9), f"{r.choice('12')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{d(2)} {d(3)} {d(3)} {d(3)}", self.mixed(), self.mixed()]
        )

    def mixed(self) -> str:
        """Letters and digits mixed, as on German, Italian, French and Dutch documents."""
        r, d = self.r, self.digits
        some = lambda n: "".join(r.choice(r.choice(["0123456789", "CFGHJKLMNPRTVWXYZ"])) for _ in range(n))
        upper = lambda n: "".join(r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") for _ in range(n))
        german = r.choice("CFGHJKLMNPRTVWXYZ") + some(6) + d(2)
        return r.choice([german, german, german + check_digit(german), german + check_digit(german), f"{r.choice('CFGHJKLMNPRTVWXYZ')}{d(2)}{upper(1)}{d(2)}{upper(1)}{d(2)}", f"C{upper(1)}{d(5)}{upper(2)}", f"{d(2)}{upper(2)}{d(5)}", f"{upper(2)}{some(6)}{d(1)}"])

    def town(self) -> str:
        r = self.r
        one = r.choice(_STARTS) + r.choice(_MIDS) + r.choice(_TOWN_ENDS)
        return r.choice([one, one, r.choice(_TOWNS), f"{r.choice(['East', 'West', 'Port', 'Fort', 'Saint', 'Bad', 'San', 'Villa'])} {one}", f"Saint-{one}", f"{one} de {self._word()}", f"{one} am {r.choice(['Main', 'See', 'Inn', 'Rhein'])}", f"{one} San {self._word()}", f"{one} {self._word()}"])

    def address(self) -> str:
        r, d = self.r, self.digits
        w, t, n = r.choice([self._word(), self._word(), r.choice(_FAMILIES)]), self.town(), r.randint(1, 199)
        return r.choice(
            [f"{n} {w} {r.choice(['Street', 'Avenue', 'Drive', 'Blvd'])}, {t}, {r.choice(['CA', 'NY', 'TX', 'WA'])} {d(5)}", f"{n} {w} {r.choice(['Road', 'Street', 'Lane'])}, {t} {r.choice(['SW', 'M', 'LS', 'EC'])}{r.randint(1, 9)} {r.randint(1, 9)}{r.choice(['AA', 'BX', 'TQ'])}", f"Calle {w} {n}, {d(5)} {t}", f"{n} {r.choice(['rue', 'avenue', 'boulevard'])} {w}, {d(5)} {t}", f"{w}str. {n}, {d(5)} {t}", f"{r.choice(['Am', 'An der', 'Im', 'Zum', 'Auf dem'])} {w} {n}, {d(5)} {t}", f"Postfach {d(4)}, {d(4)} {t}", f"{w}gasse {n}, {d(4)} {t}",
             f"{n} {w} {r.choice(['St', 'St', 'Street', 'Road', 'Lane', 'Close', 'Drive'])}, Apt {r.randint(1, 9)}{r.choice('ABC')}, {t} {d(5)}", f"{n} {w} {r.choice(['Road', 'Lane', 'Street', 'Close', 'Ave.', 'Avenue'])}, {t}", f"{r.choice(['Calle', 'C/', 'Avda.', 'Plaza', 'Paseo'])} {r.choice(['', 'la ', 'los ', 'San ', 'las '])}{w}{r.choice(['', ' ' + self._word()])}, {n}, {r.randint(1, 9)}º {r.choice('ABCD')}, {d(5)} {t}",
             f"{n}, rue {r.choice(['des ', 'du ', 'de la ', 'aux ', ''])}{w}{r.choice(['', ' ' + self._word()])}, {d(5)} {t}", f"{r.choice(['Alte ', 'Neue ', 'Lange ', '', '', ''])}{w}{r.choice(['straße', 'gasse', 'weg', 'platz'])} {n}, {d(5)} {t}", f"{w}er Weg {n}, {d(5)} {t}", f"{r.choice(['P.O. Box', 'PO Box', 'Apartado', 'Apartado de correos', 'Postfach'])} {d(4)}, {t}", f"{r.choice(['Apartado', 'Postfach'])} {d(4)}, {d(5)} {t}"]
        )

    def false(self) -> str:
        r, out = self.r, r_choice(self.r, _FALSE)
        for mark, make in (
            ("{W}", lambda: r.choice(self.openers)), ("{A}", lambda: r.choice(self.labels)), ("{B}", lambda: r.choice(self.labels).capitalize()), ("{V}", lambda: r.choice([self.phone, self.id, lambda: f"{self.digits(3)}-{self.digits(3)}-{self.digits(3)}", lambda: f"+{self.digits(1)} {self.digits(3)} {self.digits(7)}"])()), ("{O}", self.organisation), ("{P}", lambda: r.choice(_PRODUCTS)), ("{M}", self.mixed), ("{C}", lambda: (r.choice(self.topics) * 3).upper()[: r.randint(6, 8)] + self.digits(2)), ("{T}", lambda: r.choice(self.topics).capitalize()), ("{t}", lambda: r.choice(self.topics)), ("{F}", self._word), ("{D}", self.domain), ("{n}", lambda: str(r.randint(0, 97))), ("{L}", lambda: r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")),
            *((f"{{d{k}}}", lambda k=k: self.digits(k)) for k in range(1, 10)), *((f"{{h{k}}}", lambda k=k: "".join(r.choice("0123456789abcdef") for _ in range(k))) for k in (4, 8)),
        ):
            while mark in out:
                out = out.replace(mark, make(), 1)
        return out

    def organisation(self) -> str:
        r = self.r
        return r.choice([f"{r.choice(_ORG_HEADS)} {r.choice(_ORG_TAILS)}", f"{self._word()} {r.choice(_ORG_TAILS)}", f"{r.choice(_ORG_HEADS)} {self._word()} {r.choice(_ORG_TAILS)}", f"University of {self._word()}", f"{self._word()} {r.choice(['Ltd', 'Inc', 'GmbH', 'Group', 'Bank'])}"])

    def plain(self) -> str:
        s = self.r.choice(_PLAIN)
        while "{n}" in s:
            s = s.replace("{n}", str(self.r.randint(0, 900)), 1)
        return s if s[-1] in ".?" else s + "."

    def tail(self) -> str:
        """A few words of running text."""
        r = self.r
        return " " + " ".join(r.choice(self.topics) if r.random() < 0.5 else r.choice(_LITTLE) for _ in range(r.randint(1, 5)))

    def text(self) -> tuple[str, list[tuple[str, int, int]]]:
        """A text of a few lines and the (kind, start, end) of its personal data."""
        r, parts, spans = self.r, "", []
        for _ in range(r.randint(1, 4)):
            k = r.random()
            if k < 0.5:
                kind = r.choice(("name", "name", "email", "phone", "id", "address"))
                carrier = r_choice(r, _CARRIERS[kind])
                while "{t}" in carrier:
                    carrier = carrier.replace("{t}", r.choice(self.topics), 1)
                carrier = carrier.replace("{W}", r.choice(self.openers))
                while "{T}" in carrier:
                    carrier = carrier.replace("{T}", r.choice(self.topics).capitalize(), 1)
                before, after = carrier.split("{x}")
                value = getattr(self, kind)()
                if after[:1] in (".", "") and r.random() < 0.3:
                    after = self.tail() + after
                if r.random() < 0.2:
                    # The first word of another carrier, as where two notes stand on one line.
                    after += " " + r_choice(r, _CARRIERS[r.choice(("email", "phone", "id", "address", "name"))]).split(" ")[0].split("{x}")[0] + "\n"
                lead = r.choice(_LEADS) if r.random() < 0.8 else self.plain() + " "
                spans.append((kind, len(parts) + len(lead) + len(before), len(parts) + len(lead) + len(before) + len(value)))
                parts += lead + before + value + after
            else:
                parts += r.choice(_LEADS) + (self.false() if k < 0.82 else self.plain())
            parts += r.choice(["\n", "\n", " ", "\n\n"])
        return parts, spans


def hash_share(word: str) -> float:
    return zlib.crc32(word.encode()) / 2**32


def r_choice(r: random.Random, options: list[str]) -> str:
    return options[int(r.random() * len(options))]


TOPICS_UNSEEN = 10
#: Words of the sentences, which any corpus has in lower case as well.
_SAID = {w.lower() for cs in [*_CARRIERS.values(), _FALSE, _PLAIN] for c in cs for w in re.findall(r"[^\W\d_]{3,}", re.sub(r"\{\w+\}", " ", c))}
_SAID |= {w.lower() for w in [*_ORG_HEADS, *_ORG_TAILS, *" ".join(_PRODUCTS).split()] if hash_share(w) < 0.5}


def samples(n: int, seed: int) -> tuple[list[tuple[str, list[tuple[str, int, int]]]], set[str]]:
    """n labelled texts, and the words that count as common in lower case: those of the sentences, and the topics. Every tenth topic doesn't, as in a corpus
    that seldom has it in lower case; only the surroundings tell such a title from a name."""
    m = Maker(seed)
    return [m.text() for _ in range(n)], {t for i, t in enumerate(m.topics) if i % TOPICS_UNSEEN} | _SAID
