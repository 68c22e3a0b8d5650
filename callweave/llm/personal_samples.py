"""Labelled spans for training: lines with slots, filled from rules, then damaged the way subtitle files are.

Names, streets, towns and sentences come from general knowledge of the four languages or from syllables; none was copied from a
table.  The kinds of decoys, and some of the words that open lines, were widened after looking at errors on documents of sf0.1 (the
README names them).  Half of the words are made of syllables, so that the tagger learns form and place rather than a
vocabulary.  Every list is split by position: each fifth entry (``held_out``) never serves training, so accuracy on held-out lines is
measured with names, streets, frames and sentences that the tagger hasn't seen.  The number of lines is a parameter
(``SAMPLE_LINES``), the seed is fixed, so the sample is bounded and repeatable.
"""

from __future__ import annotations

import random
import unicodedata
from functools import lru_cache

SAMPLE_LINES = 160_000
SEED = 20250
LANGS = ("en", "de", "fr", "es")

# Fixed values, by language: given names, family names, and the syllables that further names are made of.
GIVEN = {
    "en": "James Mary Robert Linda Michael Susan David Karen Thomas Nancy Daniel Betty Matthew Helen Anthony Sandra Mark Donna Steven Carol Andrew Ruth Kenneth Sharon George Laura Kevin Amy Brian Angela Edward Emma Ronald Olivia Timothy Grace Jason Sophie",
    "de": "Hans Anna Peter Ursula Wolfgang Sabine Klaus Monika Jürgen Petra Dieter Renate Manfred Birgit Uwe Gisela Günter Andrea Bernd Claudia Frank Stefanie Matthias Kathrin Andreas Jutta Rüdiger Bärbel Holger Silke Lukas Hannah Jonas Lea",
    "fr": "Jean Marie Pierre Nathalie Michel Isabelle Philippe Sylvie Alain Catherine Nicolas Françoise Christophe Valérie Patrick Sandrine Frédéric Stéphanie Laurent Céline Julien Aurélie Sébastien Émilie François Chloé Jérôme Manon Étienne Mathilde",
    "es": "José María Antonio Carmen Manuel Ana Francisco Isabel Juan Laura David Cristina Javier Marta Daniel Lucía Carlos Elena Miguel Teresa Rafael Paula Pedro Raquel Ángel Rosa Sergio Mercedes Álvaro Nuria Andrés Sofía Raúl Jimena",
}
FAMILY = {
    "en": "Smith Johnson Williams Brown Taylor Davies Evans Walker Wright Robinson Thompson White Hughes Edwards Green Hall Wood Harris Clarke Jackson Turner Hill Cooper Ward Morris Moore Baker Parker Collins Murphy O'Brien McKenzie",
    "de": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann Koch Bauer Richter Klein Wolf Schröder Neumann Schwarz Zimmermann Braun Krüger Hartmann Lange Krause Lehmann Köhler Herrmann König Walter Jäger",
    "fr": "Martin Bernard Dubois Durand Moreau Laurent Lefebvre Leroy Roux Fournier Girard Bonnet Lambert Fontaine Rousseau Vincent Faure Mercier Blanc Guérin Boyer Garnier Chevalier Legrand Gauthier Perrin Morel Lemaître Béranger Aubert",
    "es": "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez Jiménez Ruiz Hernández Díaz Moreno Álvarez Romero Navarro Torres Domínguez Vázquez Ramos Gil Serrano Molina Castro Ortiz Rubio Marín Ibáñez Núñez",
}
ONSETS = "b br c ch cl d dr f fl g gr h j k kl l m n p pl pr qu r s sch sh sk sl st str t th tr v w wh z zw"
CORES = {"en": "a e i o u y ai ea ee oo ou", "de": "a e i o u ä ö ü au ei eu ie", "fr": "a e i o u é è ai au eau eu oi ou", "es": "a e i o u á é í ó ú ue ia"}
CODAS = {"en": "n r l s t d ck ll m rn sh th x nd rt lt mp", "de": "n r l s t ch ck f m tz nn ss rg ld nz pp", "fr": "n r l s t c x d nt rd gn ch", "es": "n r l s d z ll rr ñ"}
FAMILY_ENDS = {
    "en": "son ton ley ford field ham well man worth er wood by land shaw more",
    "de": "mann berg er stein bach hauser feld dorf ig ler hardt lein thal hoff ke",
    "fr": "et eau ard on ier oux elle in ault ois ot ret ert and ville",
    "es": "ez era ales os illo ado ón eda ar uela ana aga eta ero ales",
}
PARTICLES = {"en": "de van", "de": "von zu van der vom", "fr": "de du le d' de la", "es": "de de la del y dos"}
TITLES = {"en": "Mr. Mrs. Miss Ms. Doctor Dr. Professor Captain Sir Judge", "de": "Herr Frau Dr. Professor Hauptmann Doktor", "fr": "Monsieur Madame Mademoiselle Maître Docteur M. Mme", "es": "Señor Señora Don Doña Doctor Sr. Sra. Profesora"}

# Fixed values, by language: frames.  n full name, r family name first, N full name in capitals, g given name alone, f family name alone, t title,
# e address for mail, p phone, i identity number, a street address, w town, d some number, s a plain sentence.
FRAMES = {
    "en": """This is {n} speaking.|You must be {n}!|{n} called this morning.|I'd like to introduce {n}.|They arrested {n} last night.|Have you ever met {n}?|I owe {n} a favour.|{t} {n} is here to see you.|Did {t} {n} leave a message?|- Who did this? - {n}.|It was {n} all along.|{n} and {n} are getting married.|Nobody has seen {n} since Friday.
Directed by {n}|Written by {n}|Captions: {n}|Produced by {r}|Translated by {n}|Music by {n} and {n}|With {n} as the lawyer|{N}: {s}|[{n} laughing]|({n} coughs)|{n}... is that you?|I'm {n}, from the office.|Hello, {n}. Please sit down.|{s} {n} knows that.|My husband, {n}, works nights.|Case against {r}|Patient: {r}|Who is {n}, anyway?|"{n}," she said.|Thank you, {n}!
Email me: {e}|You can reach us at {e} or by phone.|My address is {e}.|Mail {e} for more information|{e}|Questions? {e}|Feedback welcome: {e}|It's {e}, all lower case.|Please reply to {e} today.|Send your comments to {e} {s}
My phone number: {p}.|Just dial {p} and ask for me.|Text {p} when you land.|Is this {p}? - Wrong number.|Mobile {p}|You can call {p} day or night.|{p}. Got that?|Emergency line: {p}|Fax {p}, phone {p}|Try {p} instead. {s}
The passport number is {i}.|SSN {i}|Your national insurance number, please. - {i}.|Tax number: {i}|Licence number {i}, born in May.|Card number {i}, issued here.|She wrote down {i} as her ID.|Identity card {i}|Social security: {i}
We moved to {a} last year.|The house is at {a}.|Meet me at {a}, ten o'clock.|Deliver this to {a}.|Number: {a}.|They found him at {a}.|{a}|Drive me to {a}!|Our new office: {a}|Is it {a}? {s}|Postal address: {a}""",
    "de": """Hier spricht {n}.|Sie sind sicher {n}!|{n} hat heute angerufen.|Darf ich {n} vorstellen?|Man hat {n} verhaftet.|Kennst du {n}?|Ich arbeite für {n}.|{t} {n} wartet draußen.|Ist {t} {n} zu sprechen?|- Wer war das? - {n}.|{n} und {n} heiraten.|Seit Freitag fehlt von {n} jede Spur.
Regie: {n}|Drehbuch: {n}|Untertitelt von {n}|Übersetzt von {r}|Musik von {n}|Mit {n} als Anwalt|{N}: {s}|[{n} lacht]|({n} hustet)|{n}... bist du das?|Guten Tag, {n}. Setzen Sie sich.|{s} {n} weiß das.|Mein Mann, {n}, schläft schon.|Patient: {r}|Wer ist eigentlich {n}?|Danke, {n}!
Meine Mail: {e}|Sie erreichen uns unter {e} oder per Post.|Mail an {e}|{e}|Fragen? {e}|Antworten Sie heute an {e}.|Es ist {e}, alles klein.|Hinweise an {e} {s}
Meine Telefonnummer: {p}.|Wählen Sie {p}.|Unter {p} bin ich da.|Handy {p}|{p}. Hast du das?|Notruf: {p}|Fax {p}, Telefon {p}|Sonst {p} probieren. {s}
Die Passnummer lautet {i}.|Steuer-ID {i}|Ihre Sozialversicherungsnummer? - {i}.|Personalausweis {i}|Führerschein Nummer {i}|Rentenversicherung: {i}|Kennnummer {i}, gültig.
Wir sind in die {a} gezogen.|Das Haus steht {a}.|Treffpunkt {a}, zehn Uhr.|Liefern Sie das an {a}.|{a}|Fahren Sie mich zur {a}!|Unser Büro: {a}|Anschrift: {a}|Ist es {a}? {s}""",
    "fr": """Ici {n} à l'appareil.|Vous devez être {n} !|{n} a appelé ce matin.|Je vous présente {n}.|On a arrêté {n} hier soir.|Tu connais {n} ?|Je travaille pour {n}.|{t} {n} vous attend.|Est-ce que {t} {n} est là ?|- Qui a fait ça ? - {n}.|{n} et {n} se marient.|Personne n'a revu {n} depuis vendredi.
Réalisé par {n}|Scénario : {n}|Sous-titres : {n}|Traduit par {r}|Musique de {n}|Avec {n} dans le rôle du juge|{N} : {s}|[{n} rit]|({n} tousse)|{n}... c'est toi ?|Bonjour, {n}. Asseyez-vous.|{s} {n} le sait.|Mon mari, {n}, dort.|Patient : {r}|Qui est {n}, au fait ?|Merci, {n} !
Mon adresse mail : {e}|Joignez-nous à {e} ou par courrier.|{e}|Des questions ? {e}|Répondez à {e} aujourd'hui.|C'est {e}, tout en minuscules.|Vos remarques à {e} {s}
Mon numéro de téléphone : {p}.|Composez le {p}.|Au {p}, jour et nuit.|Portable {p}|{p}. C'est noté ?|Urgences : {p}|Fax {p}, téléphone {p}|Essaie le {p}. {s}
Le numéro du passeport est {i}.|Numéro fiscal : {i}|Votre numéro de sécurité sociale ? - {i}.|Carte d'identité n° {i}|Permis numéro {i}|Assurance maladie : {i}
On a déménagé {a}.|La maison est au {a}.|Rendez-vous {a}, dix heures.|Livrez ça au {a}.|{a}|Conduisez-moi {a} !|Notre bureau : {a}|Adresse : {a}|C'est bien {a} ? {s}""",
    "es": """Habla {n}.|¡Usted debe de ser {n}!|{n} llamó esta mañana.|Le presento a {n}.|Anoche detuvieron a {n}.|¿Conoces a {n}?|Trabajo para {n}.|{t} {n} le espera.|¿Está {t} {n}?|- ¿Quién fue? - {n}.|{n} y {n} se casan.|Nadie ha visto a {n} desde el viernes.
Dirigida por {n}|Guion: {n}|Subtitulado por {n}|Traducido por {r}|Música de {n}|Con {n} como el abogado|{N}: {s}|[{n} se ríe]|({n} tose)|{n}... ¿eres tú?|Hola, {n}. Siéntese.|{s} {n} lo sabe.|Mi marido, {n}, duerme.|Paciente: {r}|¿Y quién es {n}?|¡Gracias, {n}!
Mi correo: {e}|Nos encuentra en {e} o por carta.|{e}|¿Preguntas? {e}|Responda hoy a {e}.|Es {e}, todo en minúsculas.|Comentarios a {e} {s}
Mi teléfono: {p}.|Marque el {p}.|En el {p}, día y noche.|Móvil {p}|{p}. ¿Lo tienes?|Urgencias: {p}|Fax {p}, teléfono {p}|Prueba con {p}. {s}
El número del pasaporte es {i}.|NIF {i}|¿Su número de la seguridad social? - {i}.|Carné de identidad {i}|Permiso número {i}|Tarjeta sanitaria: {i}
Nos mudamos a {a}.|La casa está en {a}.|Nos vemos en {a}, a las diez.|Entregue esto en {a}.|{a}|¡Lléveme a {a}!|Nuestra oficina: {a}|Dirección: {a}|¿Es {a}? {s}""",
}
PLAIN = {
    "en": """{o}|{o} is closed.|Welcome to {o}.|We met at {o}.|{t} {f}, sir!|The {o} leaves at {d}.|{o}, {d}|No, {g}, no!|Mom, {g} is crying!|{g}, come here!|{g} and {g} are late.|{t} {f} will see you now.|{t} {f}!|{G}: {s}|Goodbye, {g}.|The {w} Hotel is full.|{f} & Sons, established {d}|{f} Insurance Company|{w} United won again.|The train to {w} leaves at {d}.|Welcome to {w}!|West {w}, {d} miles|[door slams]|(music playing)|[{g} sighs]|[GUNSHOT]|♪ {s} ♪|♪♪|Page {d}, chapter {d}.|Flight {d} is boarding.|That'll be {d} dollars.|{d} percent|Score: {d}-{d}
Order number {d}|Version {d} (build {d})|Room {d}, at the end of the hall.|Subtitles: team {w}|Downloaded from www.{x}.com|Visit {x}.net for more|Follow us: @{x}|On {d} March {d}|Platform {d}, gate {d}|Serial number {d}|Reference {d}-{d}|Twenty {d} times, I said.|The {f} Tribune|Lake {f}, population {d}|What time is it? - Half past {d}.|Inspector {f}, homicide.|Saint {g} Church|The {f} case is closed.|We have one, two, three tickets left.""",
    "de": """{o}|{o} ist geschlossen.|Willkommen, {o}.|Wir waren bei {o}.|{o}, {d}|Nein, {g}, nein!|{g}, komm her!|{g} und {g} sind spät dran.|{t} {f} empfängt Sie jetzt.|{t} {f}!|{G}: {s}|Tschüss, {g}.|Das Hotel {w} ist voll.|{f} & Söhne, seit {d}|{f} Versicherung|{w} hat wieder gewonnen.|Der Zug nach {w} fährt um {d}.|Willkommen in {w}!|[Tür knallt]|(Musik spielt)|[{g} seufzt]|♪ {s} ♪|Seite {d}, Kapitel {d}.|Flug {d} ist bereit.|Das macht {d} Euro.|{d} Prozent|Spielstand {d}:{d}
Bestellung {d}|Version {d}|Zimmer {d}, ganz hinten.|Untertitel: Team {w}|Heruntergeladen von www.{x}.de|Am {d}. März {d}|Gleis {d}|Aktenzeichen {d}/{d}|Die {f} Zeitung|Kommissar {f}, Mordkommission.|Der Fall {f} ist erledigt.|Ein, zwei, drei Karten noch.""",
    "fr": """{o}|{o} est fermé.|On était à {o}.|{o}, {d}|Non, {g}, non !|{g}, viens ici !|{g} et {g} sont en retard.|{t} {f} va vous recevoir.|{t} {f} !|{G} : {s}|Au revoir, {g}.|L'hôtel {w} est complet.|{f} et fils, depuis {d}|Assurances {f}|{w} a encore gagné.|Le train pour {w} part à {d} h.|Bienvenue à {w} !|[une porte claque]|(musique)|[{g} soupire]|♪ {s} ♪|Page {d}, chapitre {d}.|Vol {d}, embarquement.|Ça fait {d} euros.|{d} pour cent|Score : {d} à {d}
Commande {d}|Version {d}|Chambre {d}, au fond.|Sous-titres : équipe {w}|Téléchargé sur www.{x}.fr|Le {d} mars {d}|Quai {d}|Référence {d}-{d}|Le journal {f}|Commissaire {f}, brigade criminelle.|L'affaire {f} est close.|Il reste un, deux, trois billets.""",
    "es": """{o}|{o} está cerrado.|Estábamos en {o}.|{o}, {d}|¡No, {g}, no!|{g}, ¡ven aquí!|{g} y {g} llegan tarde.|{t} {f} le recibe ahora.|¡{t} {f}!|{G}: {s}|Adiós, {g}.|El hotel {w} está lleno.|{f} e hijos, desde {d}|Seguros {f}|El {w} ganó otra vez.|El tren a {w} sale a las {d}.|¡Bienvenidos a {w}!|[portazo]|(música)|[{g} suspira]|♪ {s} ♪|Página {d}, capítulo {d}.|Vuelo {d}, embarque.|Son {d} euros.|{d} por ciento|Marcador: {d} a {d}
Pedido {d}|Versión {d}|Habitación {d}, al fondo.|Subtítulos: equipo {w}|Descargado de www.{x}.es|El {d} de marzo de {d}|Andén {d}|Referencia {d}-{d}|El diario {f}|Inspector {f}, homicidios.|El caso {f} está cerrado.|Quedan uno, dos, tres billetes.""",
}
# Fixed values, by language: words of everyday sentences - links, adjectives, nouns, verbs.
WORDS = {
    "en": ("the a this that my your his her our no every some and but with without for from under near of in on at to by past until through over behind into against between before after across or all these those toward beside during", "big small old new good bad red black early late warm cold easy happy quiet loud heavy empty strange broken wet fast", "dog car table night friend water school letter window street money phone story garden teacher door city game chair boat doctor river morning dinner picture train", "sees wants knows takes finds opens likes needs has makes remembers loses brings closes is was runs waits sleeps talks"),
    "de": ("der die das ein eine mein dein kein und aber mit ohne für von unter bei in auf zu nicht auch im am zum zur vom beim ins durch über gegen bis während zwischen hinter vor nach aus den dem des einen einem dass wie oder seit um", "große kleine alte neue gute schlechte rote schwarze frühe späte warme kalte leichte frohe laute leere schwere seltsame nasse schnelle", "Hund Auto Tisch Nacht Freund Wasser Schule Brief Fenster Straße Geld Stimme Garten Lehrer Tür Stadt Spiel Stuhl Boot Arzt Fluss Morgen Essen Bild Zug", "sieht will kennt nimmt findet öffnet mag braucht hat macht vergisst verliert bringt schließt ist war läuft wartet schläft redet"),
    "fr": ("le la les un une mon ta son et mais avec sans pour de sous près dans sur à pas aussi du des au aux contre devant vers entre chez derrière par jusque que ou ces cette nos", "grand petit vieux nouveau bon mauvais rouge noir facile heureux calme lourd vide étrange cassé mouillé rapide chaud froid tardif", "chien voiture table nuit ami eau école lettre fenêtre argent histoire jardin porte ville jeu chaise bateau médecin rivière matin dîner image train voix", "voit veut connaît prend trouve ouvre aime cherche a fait oublie perd apporte ferme est était court attend dort parle"),
    "es": ("el la los una un mi tu su y pero con sin para de bajo cerca en sobre a no también del al contra hasta hacia entre tras desde por que o estos esas nuestros", "grande pequeño viejo nuevo bueno malo rojo negro fácil feliz tranquilo pesado vacío extraño roto mojado rápido caliente frío tarde", "perro coche mesa noche amigo agua escuela carta ventana dinero historia jardín puerta ciudad juego silla barco médico río mañana cena foto tren voz", "ve quiere conoce toma encuentra abre busca tiene hace olvida pierde trae cierra es era corre espera duerme habla"),
}

# Fixed values, by language: what makes a name that of a place, a firm or a thing, before or after it; and other words with a capital.
ORGANS = {
    "en": "The _ Hotel|The _ Post|_ Station|_ Bank|_ Airport|University of _|Mount _|_ River|_ Bridge|_ City|_ Brothers|_ & Co.|_ Museum|Port _|Fort _|The _ Foundation|_ Rovers|_ Elementary School|Cafe _|The _ Inn|_ Island|Low _ Station|Upper _|Old _ Station|The _ Times|_ High School|_ Square|_ Mill|The _ Club|_ Street Station|_ Gazette|_ Motors|_ Theatre|Radio _|Hotel _",
    "de": "Hotel _|Der _ Bote|Bahnhof _|Bank _|Flughafen _|Universität _|_-Brücke|_ GmbH|_ AG|Museum _|Schloss _|_ Stiftung|FC _|Café _|Insel _|Gasthaus _|Radio _",
    "fr": "Hôtel _|Le Courrier de _|Gare de _|Banque _|Aéroport de _|Université de _|Mont _|Pont de _|Musée _|Château de _|Fondation _|Café _|Île de _|Olympique _|Radio _|Établissements _",
    "es": "Hotel _|El Diario de _|Estación de _|Banco _|Aeropuerto de _|Universidad de _|Monte _|Puente de _|Museo _|Castillo de _|Fundación _|Café _|Isla de _|Real _|Radio _|Hermanos _",
}
CAPITALS = {
    "en": "Monday Friday Christmas Easter English French God America London Europe Paris TV FBI OK December",
    "de": "Montag Freitag Weihnachten Ostern Gott Europa Berlin Amerika Paris TV Polizei OK Dezember",
    "fr": "Noël Pâques Dieu Europe Paris Amérique Londres Français TV OK Allemagne",
    "es": "Navidad Dios Europa Madrid América Londres París Alemania TV OK",
}

# Fixed values, by language: words that say what a number or a line is - an identity number, a phone, mail, an address; then nouns that other numbers follow.
CUES = {
    "en": {
        "i": "passport number|social security number|SSN|tax number|national insurance number|identity card|ID number|driver's licence|insurance number|ID card no.|social security|ID|ID|identification|papers|passport|passport|insurance|residence permit|personal number|tax ID|national ID|social security number is|insurance no.",
        "p": "phone number|phone|number|mobile|call|telephone|dial|cell|ring me at|reach me on|tel.|hotline|my number's|text me on|fax|extension|landline",
        "e": "e-mail|mail|write to|email address|contact|send it to|address|reply to|errors to",
        "a": "address|lives at|moved to|located at|house at|deliver to|go to|home is|driving to|send it to|taxi to",
        "d": "Invoice|Case|File|Room|Bus|Channel|Reel|Gate|Box|Unit|Article|Season|Episode|Track|Level|Highway|Flight|Order|Ticket|Version|Serial number|Reference|Batch|Floor|Frame|Model|Barcode|Tracking code|Account|Lot|Cell block|Line",
        "open": "Perhaps|Maybe|Then|Now|Today|Yesterday|Tomorrow|Meanwhile|Suddenly|Surely|Only|Even|With|And|But|So|Because|When|Featuring|Starring|Introducing|Voice of|Based on a book by|Story by|Look,|Listen,|Well,|Is|Was|Did|Mister|Find|Call|Believe|Like|Follow|To",
        "after": "please|now|thanks|right away|okay|at nine|tomorrow|sir|quickly",
    },
    "de": {
        "i": "Passnummer|Sozialversicherungsnummer|Steuernummer|Steuer-ID|Personalausweis|Ausweisnummer|Führerschein|Versicherungsnummer|Rentennummer|Versicherung|Ausweis|Ausweis|Pass|Reisepass|Steuernummer ist|Versichertennummer|Kennnummer|ID|Personalnummer",
        "p": "Telefonnummer|Telefon|Nummer|Handy|ruf an|wähl|Tel.|erreichbar unter|Rufnummer|meine Nummer|Mobil|Fax|Durchwahl|Festnetz",
        "e": "E-Mail|Mail|schreib an|Mailadresse|Kontakt|schick es an|Antwort an|Fehler an",
        "a": "Adresse|wohnt in der|gezogen in die|Haus in der|liefern an|fahr zur|Anschrift|Paket an|Taxi zur",
        "d": "Rechnung|Akte|Zimmer|Bus|Kanal|Gleis|Kiste|Artikel|Staffel|Folge|Stufe|Flug|Auftrag|Version|Seriennummer|Etage|Modell|Sendungsnummer|Konto|Los|Linie",
        "open": "Vielleicht|Dann|Jetzt|Heute|Gestern|Morgen|Plötzlich|Sicher|Nur|Sogar|Mit|Und|Aber|Also|Weil|Wenn|Es spielt|Sprecher:|Nach einem Buch von|Stimme von|Schau,|Hör zu,|Ist|War|Hat|Gesprochen von|Ein Film von|Kennen Sie|Fragen Sie|Sind Sie|Erzählt von|Sehen Sie|Gelesen von|Haben Sie",
        "after": "bitte|jetzt|danke|sofort|gut|um neun|morgen|schnell",
    },
    "fr": {
        "i": "numéro de passeport|numéro de sécurité sociale|sécu|numéro fiscal|carte d'identité|pièce d'identité|permis de conduire|numéro d'assuré|passeport|sécurité sociale|identité|passeport n°|numéro national|titre de séjour|identifiant fiscal|ID|carte d'identité",
        "p": "numéro de téléphone|téléphone|numéro|portable|appelez le|composez le|tél.|joignable au|ligne directe|mon numéro|fixe|fax|standard|rappelle au",
        "e": "e-mail|mail|écrivez à|adresse mail|contact|envoyez à|réponse à|erreurs à",
        "a": "adresse|habite au|déménagé au|située|maison au|livrer au|va au|colis pour le|taxi pour le",
        "d": "Facture|Dossier|Chambre|Bus|Chaîne|Quai|Boîte|Article|Saison|Épisode|Niveau|Vol|Commande|Version|Numéro de série|Étage|Modèle|Suivi|Compte|Lot|Ligne",
        "open": "Peut-être|Alors|Maintenant|Aujourd'hui|Hier|Demain|Soudain|Même|Avec|Et|Mais|Donc|Parce que|Quand|Voix de|D'après un livre de|Texte de|Un film de|Traduction de|Regarde,|Écoute,|Est-ce que|Chez|Pour|Appelez|Connaissez-vous|Voilà|Lu par|Croyez",
        "after": "s'il vous plaît|maintenant|merci|tout de suite|d'accord|à neuf heures|demain|vite",
    },
    "es": {
        "i": "número de pasaporte|número de la seguridad social|NIF|número fiscal|carné de identidad|documento de identidad|permiso de conducir|número de asegurado|pasaporte|DNI|DNI|afiliado|seguridad social|identidad|documento|NIE|permiso de residencia|ID|carné",
        "p": "número de teléfono|teléfono|número|móvil|llame al|marque el|tel.|localizable en el|línea directa|mi número|fijo|fax|centralita|llama al",
        "e": "e-mail|correo|escriba a|dirección de correo|contacto|envíelo a|respuesta a|errores a",
        "a": "dirección|vive en|mudado a|situada en|casa en|entregar en|vaya a|paquete para|taxi a",
        "d": "Factura|Expediente|Habitación|Autobús|Canal|Andén|Caja|Artículo|Temporada|Episodio|Nivel|Vuelo|Pedido|Versión|Número de serie|Piso|Modelo|Envío|Cuenta|Lote|Línea",
        "open": "Quizás|Entonces|Ahora|Hoy|Ayer|Mañana|De repente|Solo|Hasta|Con|Y|Pero|Así que|Porque|Cuando|Voz de|Basada en un libro de|Texto de|Una película de|Traducción de|Mira,|Oye,|¿Es|¿Y|Para|Según|Llame a|¿Conoce usted a|Pregunte por|Leído por|Crea a",
        "after": "por favor|ahora|gracias|enseguida|vale|a las nueve|mañana|rápido",
    },
}

# Fixed values, by language: what has the number of a line and goes to a town; what stands between a cue and its number.
VEHICLES = {
    "en": "Bus|Train|Tram|Night bus|Ferry|Coach|Flight|Line|Express|Shuttle",
    "de": "Bus|Zug|Tram|Nachtbus|Fähre|Flug|Linie|S-Bahn|Express|Schiff",
    "fr": "Bus|Train|Tram|Car|Bac|Vol|Ligne|Navette|Express|Bateau",
    "es": "Autobús|Tren|Tranvía|Barco|Ferri|Vuelo|Línea|Autocar|Expreso|Lanzadera",
}
COPULAS = {"en": [" is", " is", "'s"], "de": [" ist", " lautet"], "fr": [" est", ", c'est", " :"], "es": [" es", " es", ":"]}
# Endings of made German nouns and adjectives.
NOUN_ENDS, ADJECTIVE_ENDS = ["", "", "e", "en", "en", "er", "ung", "ungen", "heit", "chen"], ["e", "en", "en", "er", "igen", "lichen", "ten"]

# Parts of street addresses.
STREETS_EN = ("Church|Station|Park|Victoria|Bridge|Oak|Maple|Cedar|Queen's|North|High|Garden|Washington|School|Market|Lower Green|Old Post|St. James'", "Street|St.|Road|Rd.|Rd|Avenue|Ave|Lane|Drive|Dr.|Court|Boulevard|Blvd|Square|Place|Way|Terrace|Close|Crescent|Row|Hill")
STREETS_DE = ("Haupt|Bahnhof|Schul|Garten|Berg|Wald|Kirch|Markt|Goethe|Rosen|Wiesen|Schiller|Brunnen|Post|Burg|Tannen|Industrie", "straße|str.|weg|gasse|platz|allee|ring|ufer|damm|-Straße|steig|hof|chaussee")
STREETS_FR = ("rue|avenue|boulevard|bd|av.|place|impasse|allée|chemin|quai|passage|cours", "de la République|Victor-Hugo|des Fleurs|de la Gare|du Moulin|Saint-Michel|des Écoles|Pasteur|de Paris|du Port|des Lilas|Neuve|Haute|du Général-Leclerc|de l'Église")
STREETS_ES = ("Calle|C/|Avenida|Avda.|Av.|Plaza|Paseo|Camino|Ronda|Travesía", "Mayor|Real|del Sol|de la Constitución|San Juan|de las Flores|Cervantes|de la Paz|Nueva|del Carmen|de Madrid|Colón|Santa Ana|del Río|de los Reyes")
TOWN_ENDS = {"en": "ton ham ford bury port field ville by mouth wood", "de": "burg stadt dorf heim hausen berg bach au furt ingen", "fr": "ville court mont bourg y ac gny sur-Mer lac champs", "es": "illa ejo osa anca ares uela eda edo illo alba"}
TOWN_FIRST = {"en": "New Great Port North Saint", "de": "Bad Neu Alt Sankt Groß", "fr": "Saint- Le La Mont- Villeneuve", "es": "San Santa Villa La Puerto"}
SPOKEN = {
    "en": "zero/oh one two three four five six seven eight nine",
    "de": "null eins zwei/zwo drei vier fünf sechs sieben acht neun",
    "fr": "zéro un deux trois quatre cinq six sept huit neuf",
    "es": "cero uno dos tres cuatro cinco seis siete ocho nueve",
}
#: Names of the digits by language, in order.
DIGITS = {k: " ".join(w.split("/")[0] for w in v.split()) for k, v in SPOKEN.items()}
SPELLED = frozenset(x for v in SPOKEN.values() for w in v.split() for x in w.split("/"))
PHONES = {
    "en": "###-###-####|(###) ###-####|###.###.####|###-####|+1 ### ### ####|+44 #### ######|+44 (0)#### ######|0#### ######|0## #### ####|1-800-###-####|### ####|### ### ###",
    "de": "0## #######|0### ######|+49 ## ########|+49 (0)### ######|(0##) ########|0##/#######|0049-##-#######|0### ## ## ##|0##-######",
    "fr": "0# ## ## ## ##|0#.##.##.##.##|0#-##-##-##-##|0#########|+33 # ## ## ## ##|0033 # ## ## ## ##|+33 (0)# ## ## ## ##",
    "es": "### ### ###|### ## ## ##|#########|+34 ### ### ###|(+34) #########|0034 ### ### ###|###-##-##-##|+34 ### ## ## ##",
}
#: Forms of identity numbers: # a digit, A a letter.
IDS = {
    "en": "###-##-####|### ## ####|A########|AA######A|AA ## ## ## A|#########|AAAAA######AA#AA|A##-###-###",
    "de": "## ### ### ###|A########|##########|## ###### A ###|########A###|A######A#|AAA######",
    "fr": "# ## ## ## ### ### ##|# ## ## ## ### ###|#############|##AA#####|# ## ## ### ### ###|AA#######",
    "es": "########-A|########A|A#######-A|A#######A|AAA######|##.###.###-A|##/########/##",
}
FULL_WIDTH = str.maketrans("0123456789", "０１２３４５６７８９")
#: Letters that character recognition confuses.
MISREAD = {"o": "0", "O": "0", "l": "1I", "i": "1l", "I": "l1", "e": "c", "c": "e", "t": "f", "u": ["ii"], "m": ["rn"], "w": ["vv"], "S": "5", "s": "5", "B": "8", "b": "h", "h": "b", "n": ["ri"], "0": "O", "1": "lI", "5": "S", "8": "B"}
KINDS = ("email", "phone", "id_number", "address", "name")
_SLOT = {"n": 5, "r": 5, "N": 5, "e": 1, "p": 2, "i": 3, "a": 4}


@lru_cache(None)
def _pool(text: str, sep: str | None, held_out: bool) -> tuple[str, ...]:
    """The entries of a list that serve training, or the held-out fifth."""
    entries = [x for row in text.split("\n") for x in row.split(sep)]
    return tuple(x for k, x in enumerate(entries) if (k % 5 == 3) == held_out or len(entries) < 5)


class _Maker:
    """Draws names, numbers, addresses and sentences."""

    def __init__(self, rng: random.Random, held_out: bool):
        self.rng, self.held_out = rng, held_out

    def of(self, text: str, sep: str | None = None) -> str:
        return self.rng.choice(_pool(text, sep, self.held_out))

    def any(self, text: str, sep: str | None = None) -> str:
        return self.rng.choice(text.split(sep))

    def syllables(self, lang: str, least: int, most: int) -> str:
        r = self.rng
        out = ""
        for _ in range(r.randint(least, most)):
            out += ("" if r.random() < 0.12 else self.of(ONSETS)) + self.of(CORES[lang]) + (self.of(CODAS[lang]) if r.random() < 0.45 else "")
        return out

    def given(self, lang: str) -> str:
        r = self.rng
        out = self.of(GIVEN[lang]) if r.random() < 0.4 else (self.syllables(lang, 1, 2) + r.choice(["a", "o", "", "e", "in", "us", "iel", "ie"])).capitalize()
        return out + "-" + self.of(GIVEN[lang]) if r.random() < 0.03 else out

    def family(self, lang: str) -> str:
        r = self.rng
        way = r.random()
        if way < 0.2:
            out = self.of(FAMILY[lang])
        elif way < 0.75:
            out = (self.syllables(lang, 1, 2) + self.of(FAMILY_ENDS[lang])).capitalize()
        else:
            out = self.syllables(lang, 1, 3).capitalize()
        return out

    def name(self, lang: str, reverse: bool = False) -> str:
        r = self.rng
        given, family = self.given(lang), self.family(lang if r.random() < 0.8 else r.choice(LANGS))
        if r.random() < 0.12:
            family += ("-" if r.random() < 0.7 else " ") + self.family(lang)
        if r.random() < 0.13:
            particle = self.any(PARTICLES[lang], " ") if lang == "en" else self.any({"de": "von|zu|van der|vom", "fr": "de|du|le|de la", "es": "de|de la|del|dos"}[lang], "|")
            family = f"{particle} {family}"
        if r.random() < 0.14:
            given += f" {r.choice('ABCDEFGHIJKLMNOPRSTVW')}."
        if r.random() < 0.05:
            given += " " + self.given(lang)
        if r.random() < 0.03:
            given = f"{given[0]}. {r.choice('ABCDEJKLMPRST')}." if r.random() < 0.5 else f"{given[0]}."
        return f"{family}, {given}" if reverse else f"{given} {family}"

    def digits(self, pattern: str) -> str:
        return "".join(str(self.rng.randrange(10)) if c == "#" else self.rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c == "A" else c for c in pattern)

    def email(self, lang: str) -> str:
        r = self.rng
        plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t.replace("ß", "ss")) if ord(c) < 128 and c.isalnum()).lower()
        given, family, number = plain(self.given(lang)), plain(self.family(lang)), str(r.randrange(1, 2000))
        local = r.choice([f"{given}.{family}", f"{given}_{family}", f"{family}.{given}", f"{given[0]}{family}", f"{family}{number}", f"{given}{number}", f"{given}-{family}", f"{family}+{plain(self.syllables(lang, 1, 2))}", f"{given}_{family[:4]}{number}", given, f"{given}.{family}{number}"])
        host = plain(self.syllables(lang, 1, 3)) + r.choice(["", "", "", "-" + plain(self.syllables(lang, 1, 1)), "mail", "box", "net"])
        domain = host + "." + r.choice(["com", "org", "net", "de", "fr", "es", "co.uk", "info", "eu", "example", "test", "invalid", "example.com", "example.org", "edu"])
        kind = r.random()
        at, dot = "@", "."
        if kind < 0.08:
            at = " @ "
        elif kind < 0.16:
            at = "©"
        elif kind < 0.25:
            at, dot = r.choice([("(at)", "(dot)"), (" (at) ", " (dot) "), ("(at)", "."), ("{at}", "{dot}")])
        elif kind < 0.33:
            at, dot = r.choice([(" [at] ", "."), ("[at]", "[dot]"), (" [at] ", " [dot] ")])
        elif kind < 0.47:
            at, dot = " at ", " dot "
            local = local.replace("_", " underscore ").replace(".", " dot ").replace("+", " plus ").replace("-", " dash ")
        out = local + at + domain.replace(".", dot)
        return out.upper() if r.random() < 0.12 else out

    def grouped(self) -> str:
        """Digits of a phone number in groups, with or without a country or area code."""
        r = self.rng
        mark = r.choice([" ", " ", "-", ".", "", "/"])
        head = r.choice(["", "", "", "0", "0", "+## ", "(0##) ", "(###) ", "00##" + mark, "+##" + mark, "(+##) ", "0##/"])
        body, left = [], r.randint(6, 9)
        while left > 0:
            body.append("#" * min(left, r.choice([2, 2, 3, 3, 4])))
            left -= len(body[-1])
        return head + mark.join(body)

    def phone(self, lang: str) -> str:
        r = self.rng
        number = self.digits(self.any(PHONES[lang], "|") if r.random() < 0.7 else self.grouped())
        kind = r.random()
        if kind < 0.15:
            words = [x.split("/") for x in SPOKEN[lang].split()]
            said = [r.choice(words[int(c)]) for c in number if c.isdigit()]
            return r.choice([" ", " ", " ", ", ", "-"]).join(said)
        if kind < 0.22:
            return number.translate(FULL_WIDTH)
        if kind < 0.32:
            return number.replace("0", "O").replace("1", r.choice("1lI"))
        return number

    def identity(self, lang: str) -> str:
        """An identity number in a form of the language, or in any groups, with or without letters."""
        r = self.rng
        if r.random() < 0.7:
            return self.digits(self.any(IDS[lang], "|"))
        mark, body = r.choice(["", " ", " ", "-", "."]), []
        while sum(map(len, body)) < 6 or r.random() < 0.25:
            body.append("#" * r.choice([2, 2, 3, 3, 4]))
        head = r.choice(["", "", "", "A", "AA", "AAA"])
        return self.digits(head + (mark if head and r.random() < 0.5 else "") + mark.join(body) + (r.choice(["A", mark + "A"]) if r.random() < 0.2 else ""))

    def town(self, lang: str) -> str:
        out = (self.syllables(lang, 1, 1) + self.any(TOWN_ENDS[lang], " ")).capitalize() if self.rng.random() < 0.7 else self.syllables(lang, 2, 3).capitalize()
        first = self.any(TOWN_FIRST[lang], " ") if self.rng.random() < 0.15 else ""
        return first + ("" if first.endswith("-") or not first else " ") + out

    def address(self, lang: str) -> str:
        r = self.rng
        n, code = str(r.randrange(1, 400)), self.digits("#####")
        one = lambda: self.syllables(lang, 1, 2).capitalize() + r.choice(["", "", "er", "s"])
        street = lambda: one() + ((" " if lang != "fr" or r.random() < 0.5 else "-") + one() if lang != "de" and r.random() < 0.18 else "")
        a, b = {"en": STREETS_EN, "de": STREETS_DE, "fr": STREETS_FR, "es": STREETS_ES}[lang]
        if lang == "en":
            base = self.of(a, "|") if r.random() < 0.5 else street() + ("'s" if r.random() < 0.1 else "")
            out = f"{n}{r.choice(['', '', '', 'a', 'B'])} {base} {self.any(b, '|')}"
            out += r.choice(["", "", "", f", Flat {r.randrange(1, 30)}", f", Apt {r.randrange(1, 99)}", f", Apt. {r.randrange(1, 30)}B", f", Suite {r.randrange(1, 400)}"])
            tail = r.choice(["", "", f", {self.town(lang)}", f", {self.town(lang)} {code}", f", {self.town(lang)}, {self.digits('AA')} {code}", f", {self.town(lang)} {self.digits('AA# #AA')}"])
            return out + tail
        if lang == "de":
            kind = self.any(b, "|")
            base = self.of(a, "|") if r.random() < 0.5 else street()
            if kind[0] != "-" and r.random() < 0.12:
                kind = f"-{kind.capitalize()}"
            out = f"{base}{kind} {n}{r.choice(['', '', 'a', ' b'])}" if r.random() < 0.9 else f"{r.choice(['Am', 'An der', 'Im', 'Zum'])} {base.capitalize()} {n}"
        elif lang == "fr":
            base = self.of(b, "|") if r.random() < 0.6 else r.choice(["de ", "du ", "des ", "de la ", "aux ", "au ", "de l'", "Saint-", "", ""]) + street()
            out = f"{n}{r.choice(['', '', '', ' bis', ' ter'])}{r.choice([' ', ', '])}{self.any(a, '|')} {base}"
        else:
            base = self.of(b, "|") if r.random() < 0.6 else r.choice(["de ", "del ", "de la ", "de los ", "de las ", "San ", "Santa ", "", ""]) + street()
            out = f"{self.any(a, '|')} {base}{r.choice([' ', ', '])}{r.choice(['', '', 'n.º ', 'nº '])}{n}{r.choice(['', '', ', 3.º B', ', 2º izq.', ', bajo'])}"
        return out + r.choice(["", "", f", {self.town(lang)}", f", {code} {self.town(lang)}"])

    def number(self) -> str:
        """A number of any form: counts, times, dates, prices, versions, file numbers."""
        r = self.rng
        if r.random() < 0.5:
            return self.digits(r.choice(["#", "##", "###", "####", "19##", "20##", "#.##", "#:##", "##:##", "##.##", "#,###", "#.###.###", "#,###,###", "##/##/####", "##.##.####", "#.#.#", "#.##.#", "##%", "#.#####e-##", "#e#", "#.####", "####x###", "## h ##", "##h##", "## h", "#e", "##-##-##"]))
        mark = r.choice(["", "-", "-", "/", ".", " ", ":", "_", "#"])
        groups = ["#" * r.choice([1, 2, 2, 3, 4, 4, 5, 6, 8]) for _ in range(r.choice([1, 1, 2, 2, 3, 3, 4]))]
        return self.digits(r.choice(["", "", "", "", "A", "AA", "#A", "AA-", "20##-"]) + mark.join(groups))

    def carried(self, lang: str) -> str:
        """A frame made on the spot: a slot between random words, after a cue where numbers need one."""
        r = self.rng
        cues = CUES[lang]
        slot = r.choice("nnnnnnrNeppiiiaaaddddd")
        few = lambda: " ".join(self.sentence(lang, bare=True).split()[: r.randint(1, 4)])
        if slot in "nr" and r.random() < 0.45:
            title = "{t} " if slot == "n" and r.random() < 0.12 else ""
            opened = self.of(cues["open"], "|") + " " if r.random() < 0.85 else r.choice(["", "- ", "¡" if lang == "es" else "", "¿" if lang == "es" else "\""])
            return f"{opened}{title}{{{slot}}}{r.choice([' ', ' ', ' ', ', ']) + few() if r.random() < 0.6 else ''}".strip() + r.choice([".", "", "!", "?", "..."])
        before, after = few() if r.random() < 0.6 else "", few() if r.random() < 0.45 else ""
        if slot in "piead" and r.random() < (0.55 if slot in "ea" else 0.95):
            cue = self.of(cues[slot], "|")
            cue = cue[0].upper() + cue[1:] if r.random() < 0.4 else cue
            before = (before + " " if before and r.random() < 0.5 else "") + cue + r.choice(["", "", "", ":", ":", r.choice(COPULAS[lang]), r.choice(COPULAS[lang]), "?", ",", " -"])
        elif slot == "r":
            before += ":" if before else ""
        if r.random() < 0.2:
            after = ", " + self.of(cues["after"], "|") + r.choice([".", "!", ""])
        elif after:
            after = r.choice([" ", " ", " ", ", ", ". ", "? - ", " - "]) + after
        else:
            after = r.choice([".", ".", "", "!", "?", ",", "...", ":"]) if slot not in "e" or r.random() < 0.5 else ""
        if slot == "N" and r.random() < 0.7:
            before, after = "", ": {s}"
        frame = f"{before} {{{slot}}}{after}".strip()
        if r.random() < 0.08:
            frame = r.choice(["[_]", "(_)", "<i>_</i>", "\"_\"", "♪ _ ♪", "-= _ =-"]).replace("_", frame)
        return frame[0].upper() + frame[1:] if r.random() < 0.6 else frame

    def decoy(self, lang: str) -> str:
        """Lines that look like personal data and are none."""
        r = self.rng
        _, adjectives, nouns, verbs = WORDS[lang]
        loud = [self.word(lang) if r.random() < 0.5 else self.of(r.choice([adjectives, nouns, verbs])) for _ in range(r.choice([1, 2, 2, 2, 3]))]
        caps = " ".join(loud if r.random() < 0.7 else self.sentence(lang, bare=True).split()[: r.randint(1, 4)]).upper()
        some = lambda t: (self.of(t) if r.random() < 0.5 else self.word(lang)).capitalize()
        title = {"en": f"The {some(adjectives)} {some(nouns)}", "de": f"{r.choice(['Der', 'Die', 'Das'])} {some(adjectives)} {some(nouns)}", "fr": f"{r.choice(['Le', 'La', 'Les'])} {some(nouns)} {some(adjectives)}", "es": f"{r.choice(['El', 'La', 'Los'])} {some(nouns)} {some(adjectives)}"}[lang]
        handle = r.choice(["@{x}", "@{x}{x}", "@{x}_{d}", "#{x}", "www.{x}.com", "{x}.net/{x}", "http://{x}.org", "team {x}", "Team {x}"])
        number = self.of(CUES[lang]["d"], "|") + " {d}"
        travel = {"en": ["to {w}", "for {w}", "from {w}"], "de": ["nach {w}", "aus {w}"], "fr": ["pour {w}", "à {w}", "de {w}"], "es": ["a {w}", "para {w}", "de {w}"]}[lang]
        vehicle = self.of(VEHICLES[lang], "|")
        clock = {"en": "at {d}", "de": "um {d}", "fr": "à {d}", "es": "a las {d}"}[lang]
        lines = {
            "sound": [f"[{caps}]", f"[{caps}]", f"({caps})", f"({caps})", f"[♪ {caps.lower()} ♪]", f"[{caps.lower()}]", f"({caps.lower()})", f"- [{caps}]", f"[{caps}] {{s}}", caps],
            "travel": [f"{vehicle} {{l}} {r.choice(travel)}{r.choice(['.', '', ',', '!'])}", f"{vehicle} {{l}} {r.choice(travel)}. {{s}}", f"{{s}} {vehicle} {{l}} {r.choice(travel)}.", f"{{l}} {r.choice(travel)}", f"{{l}} {some(adjectives)} {some(nouns)}"],
            "title": [title, f"{title} {self.of(verbs)} {clock}.", f"{title} {self.of(verbs)} {{s}}", f"{{s}} {title}", f"{title}, {{d}}"],
            "handle": [handle, f"{{s}} {handle}", f"-= {handle} =-", f"-= {some(nouns)} by {handle} =-", f"by {handle}"],
            "number": [f"{number}, {{s}}", f"{number} {r.choice(travel)}", f"{number} {clock}.", f"{number}.", f"{{s}} {number}", f"{number}, {self.of(adjectives)} {self.of(nouns)}."],
            "partly": ["{g}, {g}!", "{t} {f}, {s}", "{t} {f}.", "{g}!", "{G}!", "{G}: {s}", "{g} {s}", "{s} {g}.", "{f}, {s}"],
            "organ": ["{o}", "{o} {s}", "{s} {o}", f"{{o}} {clock}.", "{o}."],
        }
        return r.choice(lines[r.choice(list(lines))])

    def organ(self, lang: str) -> str:
        """A place, a firm or a thing with a name: no person."""
        r = self.rng
        own = lambda: self.word(lang).capitalize() if r.random() < 0.5 else self.of(WORDS[lang][1 + r.randrange(2)]).capitalize() if r.random() < 0.5 else self.family(lang)
        return self.of(ORGANS[lang], "|").replace("_", own() + (" " + own() if r.random() < 0.3 else ""))

    def word(self, lang: str) -> str:
        return self.syllables(lang, 1, 3)

    def sentence(self, lang: str, bare: bool = False) -> str:
        """A sentence of everyday or made words; ``bare`` without names, capitals and marks."""
        r = self.rng
        links, adjectives, nouns, verbs = WORDS[lang]
        made = r.random() < 0.5

        def pick(text: str) -> str:
            if made and text is not links and r.random() < 0.8:
                out = self.word(lang)
                if lang == "de" and text is not verbs:
                    return (out + r.choice(NOUN_ENDS)).capitalize() if text is nouns else out + r.choice(ADJECTIVE_ENDS)
                return out
            return self.of(text)

        def phrase() -> list[str]:
            noun = [pick(nouns)]
            if r.random() < 0.6:
                noun = [pick(adjectives), *noun] if lang in ("en", "de") else [*noun, pick(adjectives)]
            return [self.of(links), *noun]

        words = phrase() + [pick(verbs)] + phrase() + (([self.of(links)] if r.random() < 0.4 else []) + phrase() if r.random() < 0.5 else [])
        if bare:
            return " ".join(words)
        if r.random() < 0.15:
            named = r.choice([self.organ, self.town, self.given, lambda x: self.of(CAPITALS[x]), lambda x: f"{self.any(TITLES[x])} {self.family(x)}"])(lang)
            words.insert(r.randrange(len(words) + 1), named)
        if r.random() < 0.35:
            words = words[r.randrange(len(words)) :]
        if r.random() < 0.2:
            words = words[: r.randint(1, 3)]
        text = " ".join(words)
        if r.random() < 0.8:
            text = text[0].upper() + text[1:]
        if r.random() < 0.1:
            text = text.replace(" ", ", ", 1)
        mark = r.choice([".", ".", ".", "!", "?", "...", "…", ""])
        return ("¿" if lang == "es" and mark == "?" else "¡" if lang == "es" and mark == "!" else "") + text + (" " if lang == "fr" and mark in ("!", "?") else "") + mark

    def script(self) -> str:
        """Words of other scripts: letters drawn from a range."""
        r = self.rng
        low, high, longest = r.choice([(0x430, 0x44F, 9), (0x3B1, 0x3C9, 9), (0x627, 0x64A, 8), (0x3042, 0x3093, 6), (0x4E00, 0x9000, 4), (0x5D0, 0x5EA, 7), (0xAC00, 0xD000, 4), (0x915, 0x939, 6)])
        words = ["".join(chr(r.randint(low, high)) for _ in range(r.randint(1, longest))) for _ in range(r.randint(1, 8))]
        if low in (0x430, 0x3B1):
            words = [w.capitalize() if r.random() < 0.25 else w for w in words]
        return " ".join(words) + r.choice(["", ".", "?", "…", "!"])

    def fill(self, lang: str, frame: str) -> tuple[str, list[int]]:
        r, text, labels = self.rng, "", []
        while "{" in frame:
            before, _, rest = frame.partition("{")
            slot, frame = rest[0], rest[2:]
            text, labels = text + before, labels + [0] * len(before)
            value = {
                "n": lambda: self.name(lang), "r": lambda: self.name(lang, True), "N": lambda: self.name(lang).upper(), "g": lambda: self.given(lang), "G": lambda: self.given(lang).upper(),
                "f": lambda: self.family(lang), "t": lambda: self.any(TITLES[lang]), "e": lambda: self.email(lang), "p": lambda: self.phone(lang), "i": lambda: self.identity(lang),
                "a": lambda: self.address(lang), "w": lambda: self.town(lang), "d": self.number, "l": lambda: str(r.randrange(1, 400)), "s": lambda: self.sentence(lang), "x": lambda: self.word("en"), "o": lambda: self.organ(lang),
            }[slot]()
            kind = _SLOT.get(slot, 0)
            labels += [2 * kind - 1] + [2 * kind] * (len(value) - 1) if kind else [0] * len(value)
            text += value
        return text + frame, labels + [0] * len(frame)


def _damage(rng: random.Random, text: str, labels: list[int]) -> tuple[str, list[int]]:
    """Misread letters, wrong encodings, lost accents or capitals; labels follow their characters."""
    kind = rng.random()
    if kind < 0.68:
        return text, labels
    out: list[str] = []
    own: list[int] = []

    def put(piece: str, label: int) -> None:
        out.append(piece)
        own.extend([label] + [label + 1 if label % 2 else label] * (len(piece) - 1))

    if kind < 0.81:
        rate = rng.choice([0.05, 0.15])
        for c, label in zip(text, labels):
            swap = MISREAD.get(c)
            put(rng.choice(list(swap)) if swap and rng.random() < rate else c, label)
    elif kind < 0.91:
        way = rng.random()
        for c, label in zip(text, labels):
            if ord(c) < 128:
                put(c, label)
            elif way < 0.3:
                put(c.encode().decode("cp1252", "replace"), label)
            elif way < 0.45:
                put(c.encode().decode("latin-1").encode().decode("latin-1"), label)
            elif way < 0.7:
                put("�" if way < 0.6 else "?", label)
            else:
                put(c.encode("cp1252", "replace").decode("cp1251", "replace"), label)
    elif kind < 0.95:
        for c, label in zip(text, labels):
            put("".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) or c, label)
    else:
        for c, label in zip(text, labels):
            put(c.upper() if len(c.upper()) == 1 else c, label)
    return "".join(out), own


def sample(count: int = SAMPLE_LINES, seed: int = SEED, held_out: bool = False) -> list[tuple[str, list[int]]]:
    """``count`` lines with a label per character: 0 outside, 2k - 1 the first and 2k a later character of kind k."""
    rng = random.Random(seed)
    make = _Maker(rng, held_out)
    out = []
    for _ in range(count):
        lang = rng.choices(LANGS, [4, 2, 2, 2])[0]
        text, labels = "", []
        for _ in range(rng.choice([1, 1, 1, 2, 2, 3])):
            way = rng.random()
            if way < 0.5:
                t, own = make.fill(lang, make.carried(lang) if way < 0.28 else make.of(FRAMES[lang], "|"))
            elif way < 0.74:
                t, own = make.fill(lang, make.decoy(lang) if way < 0.62 else make.of(PLAIN[lang], "|"))
            else:
                t = make.script() if way > 0.95 else make.sentence(lang)
                own = [0] * len(t)
            if way >= 0.5 and rng.random() < 0.17 and len(t.upper()) == len(t):
                t = t.upper()
            if rng.random() < 0.08:
                t, own = "- " + t, [0, 0, *own]
            if text:
                text, labels = text + " ", labels + [0]
            text, labels = text + t, labels + own
        out.append(_damage(rng, text, labels))
    return out
