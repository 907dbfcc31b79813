"""Sentences and names for testing the redaction: written apart from those of pii_samples, and none of them is used in fitting."""

NAMES = (
    "John Smith;Sarah O'Connor;Michael Thompson;Priya Raman;Aoife Byrne;Liam Gallagher;Chloe Bennett;Harold Whitfield;Daniel Osei;Megan Pritchard;Tobias Lindqvist;Ingrid Halvorsen;Niamh Kelly;George Papadopoulos;Zofia Wójcik;Marek Dvořák;"
    "Lucía Herrera;Joaquín Salcedo;Ana Belén Castaño;Íñigo Urrutia;Rosario del Pozo;Esteban Quiroga;Pilar Montesinos;Gonzalo Arrieta;Maite Zubiri;Álvaro de la Fuente;Noelia Campos;Héctor Villanueva;"
    "Amélie Rousseau;Thierry Delacroix;Benoît Lemaire;Hélène Marchand;Étienne Caron;Solène Guichard;Jean-Luc Barthez;Mathilde Aubert;Gaspard Renaud;Yannick Le Goff;"
    "Klaus Hartmann;Birgit Vogel;Jürgen Steinbach;Annika Brandt;Matthias Eichhorn;Ulrike Sommer;Heiko von Arnim;Svenja Kästner;Florian Adler;Gudrun Pfeiffer;"
    "A. J. Turner;R. Mendoza;Emily R. Watson;GARCIA LOPEZ MARIA;Novak, Petra;Campbell, Duncan;Okafor, Chidi;Giulia Moretti;Hiroshi Tanaka;Amina Diallo;Farid Benali;Mei Lin Zhou"
).split(";")

TRUE = {
    "name": [
        "The keys are with {x} until noon.", "Lunch was paid by {x}.", "{x} asked whether the bridge is open.", "Yesterday {x} sent me the slides.", "Best,\n{x}", "Presented by {x}", "El taller lo da {x} esta tarde.", "Nos atendió {x} muy bien.", "{x} preguntó por la factura del gas.", "Le rapport a été relu par {x}.", "J'ai vu {x} au marché.",
        "Der Vortrag von {x} fällt aus.", "Gestern rief {x} an.", "author: {x}", "Dear {x},", "Mr. {x} has moved abroad.", "A reply from {x} is still missing.", "Según nos contó {x}, llovía.", "Sincères salutations,\n{x}", "Teilnehmerin: {x}",
    ],
    "email": ["Drop a line to {x} any time.", "newsletter goes to {x}", "mi dirección nueva es {x}", "réponse attendue : {x}", "Rückfragen bitte an {x}", "login = '{x}'", "Bcc: {x}", "({x} will not be read)", "{x} is full"],
    "phone": ["After hours please dial {x}.", "Landline {x}", "Mi número nuevo es el {x}.", "Vous pouvez me joindre au {x}.", "Meine Nummer lautet {x}.", "tel={x}", "The clinic's number is {x}.", "Llámame al {x} mañana.", "Mobile {x}"],
    "id": ["She travels on passport {x}.", "National insurance: {x}", "Adjunto copia del DNI {x}.", "Numéro de passeport {x}", "Ihr Personalausweis {x} liegt hier.", "ssn: {x}", "residence permit no. {x}", "mi NIE es el {x}", "identity number {x} is wrong"],
    "address": ["Please send the chairs to {x}.", "Her new flat is at {x}.", "Mi casa está en {x}.", "Notre atelier se trouve {x}.", "Unsere Praxis: {x}", "shipTo: {x}", "Pick up at {x} tomorrow.", "Vive en {x} desde mayo."],
}
VALUES = {
    "email": ["jane.roe@acme-tools.com", "pedro_luis@correo.es", "k.meier@firma.de", "info2@atelier.fr", "ana (at) taller (dot) es", "bob [at] plant [dot] org", "x.y+news@uni.edu"],
    "phone": ["+1 415 283 9071", "(212) 664-7665", "+44 161 496 0123", "020 7183 8750", "+34 612 345 678", "91 523 45 67", "+33 1 42 68 53 00", "06 12 34 56 78", "+49 89 636480 18", "030 901820", "+39 06 6982 1234", "503-226-1419"],
    "id": ["12345678Z", "87.654.321-X", "Y2345678Z", "X-1234567-L", "123-45-6789", "521 33 8417", "AB 12 34 56 C", "JG103759A", "PA0293847", "C01X00T47", "L8G4K21P0"],
    "address": ["221 Baker Street, London", "1600 Amphitheatre Drive, Springfield, CA 94043", "14 Elm Road, Leeds LS1 4DY", "Calle Mayor, 12, 3º B, 28013 Madrid", "Avenida Goya 7, 50006 Zaragoza", "25 rue Lafayette, 75009 Paris", "8 bis, rue des Lilas, 69003 Lyon", "Hauptstraße 5, 10827 Berlin", "Am Markt 3, 28195 Bremen", "P.O. Box 2231, Denver", "Postfach 1204, 8021 Zürich"],
}
#: Lines without personal data.
FALSE = [
    "The United Nations met on Tuesday.", "We moved to Apache Spark last year.", "Open the folder in Visual Studio Code.", "Amazon Web Services had an outage.", "The Red Cross sent help.", "Deutsche Bank raised its rates.", "She studies at Harvard University.", "It runs on Windows Server.", "The European Commission disagrees.", "Google Cloud Platform is cheaper.",
    "ISBN 978-0-306-40615-7", "Invoice 2023-114-8842 is overdue.", "Flight 447 left at 10:35.", "Error 0x80070057 in module 12.", "Release 12.4.1-2023.10.11", "The chip is a 74HC595 from 2019.", "Serial no. 4C3A99812X", "part no. 12345678Z of the pump", "order 4471-22-9913 shipped", "UTC 2024-05-06 07:08:09", "Coordinates 48.858370, 2.294481", "Commit 9f2c1ab is broken.",
    "pip install requests==2.31.0", "git@github.com:pallets/flask.git", "import numpy as np  # version 1.26.4", "sprite@2x.png", "react@18.2.0", "Main Street is closed.", "the 5 Avenue line", "rue de la Paix", "A Tale of Two Cities", "Frequently Asked Questions", "Getting Started", "Table of Contents", "Terms and Conditions", "New York is far.", "San Sebastián en verano", "Buenos Aires queda lejos.", "Les Misérables", "Der Spiegel berichtet.", "Good Friday is a holiday.",
    "total: 1,234,567.89", "Call stack size exceeded", "The Bank of England", "Lake Geneva", "World War Two", "Los Angeles Times", "Santa Claus is coming", "Machine Learning Pipeline", "Data Processing Report", "Task Force One", "checksum 184467440737", "lote 123-45-6789 caducado", "batch AB123456C",
]
