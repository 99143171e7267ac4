"""The labelled table for the tagger of personal information.

Each row is one or two frames with labelled stretches in braces by kind: ``{name}``, ``{given}``, ``{email}``, ``{phone}``,
``{address}`` and the identity numbers ``{ssn}``, ``{nino}``, ``{passport}``, ``{steuer}``, ``{ausweis}``, ``{nir}``. Frames
without braces of these kinds teach what is no personal information. Other braces are plain words. The frames are written from
general knowledge of letters, minutes, logs, forms and source files in English, German and French, not taken from any corpus,
and no real person is named. ``labelled_rows`` fills the braces by rule and swaps some of the plain words for others, so that
the tagger leans on the form of what is labelled and not on the words of a frame. ``part`` keeps whole frames apart for tests.
"""

from __future__ import annotations

import random
import re
import zlib

FRAMES = {
    "en": """
Dear {title}{name},
Hi {given},
Hello {given}, thank you for your note about the {obj}.
Best wishes, {name}
Kind regards\\n{name}\\n{phone}
Cheers, {given}
Yours sincerely,\\n{name}\\n{address}
{given}: can somebody look at the {obj}?
@{given} could you {verb} the {obj} today?
Thanks @{given}, done.
Attendees: {name}; {name}; {name}
In attendance were {name}, {name} and two people from {firm}.
Apologies were received from {name}.
Minutes taken by {name}, chaired by {title}{name}.
Action: {name} to {verb} the {obj} by Friday.
Action {n} - {given} will {verb} the {things}.
Owner: {name}. Due: week {n}.
{name} of {firm} explained how the {things} are fixed.
{name} from {firm} walked the {place} with {name}.
{title}{name} asked why the {obj} had been {past}.
According to {name}, the {things} were {past} twice.
We agreed with {title}{name} that the {obj} stays.
{name} noticed water near the {obj} and told {name}.
Yesterday {name} {past} the {things} in bay {n}.
The {obj} was {past} by {name} and {past} again by {given}.
Signed off by {name} on site.
Prepared by: {name}   Reviewed by: {name}
Site manager: {name}, mobile {phone}
Designer - {name} - {email}
For questions ring {name} on {phone} or write to {email}.
Please reply to {email} with your comments.
You can reach me at {email} or {phone}.
My new number is {phone}.
Tel. {phone} / Fax {phone}
Emergency contact {phone}, ask for {given}.
Phone {phone} before you drive to the {place}.
Mail the list to {email}, copy to {email}.
From: {name} <{email}>
To: {email}, {email}
Author: {name} ({email})
Committed by {name} <{email}> in revision {n}
user={email} action=upload size={n}
"contact": "{email}", "phone": "{phone}"
<owner>{name}</owner><mail>{email}</mail>
IFCPERSON('{n}','{name}',$,$,$);
IFCACTORROLE ... telephone '{phone}', electronic '{email}'
ResponsibleEngineer={name};Contact={email}
reported by "{name}", assigned to "{name}"
Send samples to {address}.
Our office has moved to {address}, please update your records.
Parcels for {name} go to {address}.
{firm} can be found at {address}.
The owner lives at {address} and keeps the keys.
Invoice address: {address}
Post: {address}. Phone: {phone}.
{name}, {address}, {phone}
Meet at {address} at nine.
{name}'s {ssnl} is {ssn}.
{name}'s {ninol} is {nino}.
{name}, {passl} {passport}, has been inducted.
Card holder {name} ({ssnl} {ssn}).
{ssnl} {ssn} appears on the old form.
Remove {ninol} {nino} from the shared folder.
Somebody scanned a page with {passl} {passport} on it.
Visitors: {name} ({passl} {passport}), {name} ({ninol} {nino})
Payroll has {ninol} {nino} for {name}.
Security check failed for {passl} {passport} at the gate.
Tax form, {taxl} {ssn}, signed {name}
{name} ({email}) left a comment: the {obj} is too low.
Ask {name} if the {things} fit.
{name} says no.
{name} - absent; {name} - present
Both {name} and {name} have {past} their {things}.
{name}: "{obj} is fine."
Spoke to {name} by phone ({phone}); the {obj} is late.
Crew: {given}, {given}, {given}
Handed the drawings to {title}{name} at the {place}.
Letter from {title}{name} about noise from the {place}.
Interview with {name}, foreman at {firm}
""",
    "de": """
Sehr geehrte {titlef}{name},
Hallo {given},
Liebe {given}, danke für die Pläne.
Viele Grüße\\n{name}
Mit freundlichen Grüßen\\n{name}\\n{phone}
Beste Grüße, {given}
Teilnehmer: {name}, {name}, {name}
Anwesend waren {name} und {name} von {firm}.
Entschuldigt: {name}
Protokoll: {name}
Aufgabe {n}: {name} soll {Ding} bis Freitag ändern.
{name} ({firm}) hat {Ding} abgenommen.
{titlef}{name} fragt, warum {Ding} fehlt.
Nach Auskunft von {titlef}{name} werden {Dinge} erst später geliefert.
{Ding} wurde von {name} geprüft.
{name} meldet einen Schaden an {Dinge}.
Abgestimmt mit {name} am Telefon.
Bauleiter: {name}, Handy {phone}
Ansprechpartnerin ist {name}, {email}.
Bei Fragen bitte {name} anrufen: {phone}.
Bitte die Liste an {email} schicken.
Telefon {phone}, Fax {phone}
Neue Nummer: {phone}
Sie erreichen uns unter {phone} oder per Mail an {email}.
Unsere Anschrift: {address}
Das Lager ist umgezogen: {address}
Pakete bitte an {name}, {address}.
{firm}, {address}, Tel. {phone}
Treffpunkt {address} um acht Uhr.
{name}, {steuerl} {steuer}
{steuerl} {steuer} steht noch auf dem alten Formular.
{name} hat sich mit {ausweisl} {ausweis} ausgewiesen.
{ausweisl} {ausweis} wurde am Tor notiert.
Kopie gelöscht: {ausweisl} {ausweis} von {name}
Lohnbüro braucht {steuerl} {steuer}.
Übergabe durch {name} an {name}.
{name} und {given} haben {Dinge} gezählt.
Erstellt: {name} / Geprüft: {name}
Besuch von {titlef}{name} auf der Baustelle.
Die Planung hat {name} übernommen.
""",
    "fr": """
Bonjour {titlef}{name},
Bonjour {given},
Chère {given}, merci pour les plans.
Bien cordialement,\\n{name}
Salutations, {name}\\n{phone}
Merci, {given}
Présents : {name}, {name}, {name}
Étaient présents {name} et {name} de la société {firm}.
Excusé : {name}
Compte rendu rédigé par {name}
Action {n} : {name} doit revoir {chose} avant vendredi.
{name} ({firm}) a réceptionné {chose}.
{titlef}{name} demande pourquoi {chose} manque.
D'après {titlef}{name}, {choses} arrivent plus tard.
{chose} a été contrôlé par {name}.
{name} signale un défaut sur {choses}.
Vu avec {name} au téléphone.
Chef de chantier : {name}, portable {phone}
Votre contact est {name}, {email}.
Pour toute question appeler {name} au {phone}.
Merci de transmettre la liste à {email}.
Téléphone {phone}, télécopie {phone}
Nouveau numéro : {phone}
Vous pouvez nous joindre au {phone} ou par courriel à {email}.
Notre adresse : {address}
Le bureau a déménagé : {address}
Envoyer les colis à {name}, {address}.
{firm}, {address}, tél. {phone}
Rendez-vous au {address} à huit heures.
{name}, {nirl} {nir}
{nirl} {nir} figure encore sur l'ancien formulaire.
{name} a présenté {passfr} {passport} à l'entrée.
Supprimer {nirl} {nir} du dossier partagé.
{name} et {given} ont compté {choses}.
Établi par {name} / Vérifié par {name}
Visite de {titlef}{name} sur le chantier.
L'étude est suivie par {name}.
Remise des clés par {name} à {name}.
""",
}

PLAIN = {
    "en": """
The {obj} was {past} and the {things} are still missing.
{Things} {past} on level {n}, zone {X}.
Please {verb} the {obj} next to grid {X}/{n}.
Weather: {n} degrees, light rain, {n} people on site.
{tool} crashed after {n} minutes with {n} {things} open.
Steps: open the file, {verb} the {obj}, save, run the {tool}.
Expected {n} {things}, found {n}.
Order {code} covers {n} {things}.
Drawing {code} replaces drawing {code}.
Delivery note {code}, pallet {n} of {n}
Asset tag {code}; serial {code}
Part number {code} is sold out.
Ticket {code} is a duplicate of {code}.
Coordinates {x}, {x}, {x}
Origin at {x} {x} {x}, rotation {n} degrees
GUID {guid} is used twice.
{guid} {guid}
Element {gid} ({cls}) has no {attr}.
#{n}={cls}('{gid}',#{n},$,$);
{cls}, {cls} and {cls} share one {attr}.
{firm} delivers {n} {things} on Monday.
{firm} and {firm} disagree about the {obj}.
The {place} at {town} opens in {n} weeks.
Trains from {town} to {town} pass behind the {place}.
{town} and {town} have the same soil.
Fire rating REI {n}, thickness {len}, width {len}.
{n}.{n} The {obj} shall be {past} before the {things} are fixed.
{n}.{n}.{n} {Things} shall comply with EN {n}-{n}.
Clause {n}.{n}: {Things} and the {obj}
Version {n}.{n}.{n} fixes the {tool} and {n} other defects.
[INFO] {tool} finished in {n} s, {n} warnings
{d4}-{d2}-{d2} {d2}:{d2}:{d2} ERROR {tool}: {attr} is empty
Opened {d2}.{d2}.{d4}, closed {d2}/{d2}/{d4}
Revision {X} of sheet {n} was sent on Tuesday.
Stone, Brick and Timber walls are listed apart.
Mark each Beam, Hill drain and Field gate in red.
The Mason and the Carpenter start on Monday; the Baker next door complained.
Grant and permit documents may arrive in May.
We will frank the letters and bill the hours.
Level {n}, Room {n}.{n}, Door {n}
See https://docs.example/{attr}/{n} for the {tool}.
Branch {n} was merged without the {attr}.
Can the {tool} {verb} {things} by {attr}?
Total: {n} {things}, {n} of them {past}
Meeting with the fire brigade on Thursday in the {place}.
The client, the architect and the site manager want the {obj} higher.
Nobody from {firm} came.
Room Data Sheet, Bill of Quantities, Method Statement
Question {n}: which {attr} belongs to the {obj}?
If {n} {things} weigh {n} kg each, how much does the {obj} carry?
Quantity {n} m2 at {x} per unit
Budget {n} {n}00 for the {obj}
Account {code}, contract {code}
North Tower, South Wing, Dock Road bridge and Market Square are out of scope.
{n} {things}, {len} long, {past} in the {place}
""",
    "de": """
{Ding} wurde geändert, {Dinge} fehlen noch.
{Dinge} in Ebene {n}, Achse {X}/{n} versetzt.
Bitte {Ding} neben Achse {X} prüfen.
Wetter: {n} Grad, Regen, {n} Leute auf der Baustelle.
Bestellung {code} umfasst {n} {Dinge}.
Plan {code} ersetzt Plan {code}.
Seriennummer {code}
{firm} liefert {n} {Dinge} am Montag.
Der Rohbau in {town} ruht seit {n} Wochen.
Zwischen {town} und {town} liegt die neue Strecke.
Bauteil {gid} ({cls}) hat kein {attr}.
{n}.{n} {Ding} ist vor dem Einbau der {Dinge} zu prüfen.
Die Bauleitung, der Architekt und der Prüfer wollen {Ding} höher.
Der Maurer und der Zimmermann beginnen am Montag.
Welche Dicke hat {Ding}, wenn {n} {Dinge} entfallen?
Raum {n}.{n}, Tür {n}, Geschoss {n}
Die Prüfung der {Dinge} dauert {n} Minuten.
Koordinaten {x} {x} {x}
Feuerwiderstand F {n}, Dicke {len}
Nach der Abnahme werden {Dinge} und {Ding} gestrichen.
Es fehlen {n} {Dinge} im Lager.
""",
    "fr": """
{chose} a été modifié, {choses} manquent encore.
{choses} posés au niveau {n}, axe {X}/{n}.
Merci de vérifier {chose} près de l'axe {X}.
Météo : {n} degrés, pluie, {n} personnes sur le chantier.
La commande {code} comprend {n} {choses}.
Le plan {code} remplace le plan {code}.
Numéro de série {code}
{firm} livre {n} {choses} lundi.
Le gros œuvre à {town} est arrêté depuis {n} semaines.
Entre {town} et {town} passe la nouvelle ligne.
L'élément {gid} ({cls}) n'a pas de {attr}.
{n}.{n} {chose} est à contrôler avant la pose des {choses}.
La maîtrise d'œuvre, l'architecte et le contrôleur veulent {chose} plus haut.
Le maçon et le charpentier commencent lundi.
Quelle épaisseur pour {chose} si {n} {choses} sont supprimés ?
Local {n}.{n}, porte {n}, étage {n}
Le contrôle des {choses} dure {n} minutes.
Coordonnées {x} {x} {x}
Résistance au feu EI {n}, épaisseur {len}
Après la réception, {choses} et {chose} seront peints.
Il manque {n} {choses} au dépôt.
""",
}

#: Sentence plans from which further frames are put together: what a person, and what a firm, town or thing, may stand beside.
PLANS = {
    "en": """
{name} {did} the {obj}.
{name} {did} {things} and {did} the {obj}
{name} will {verb} the {obj} {when}.
{role}: {name}
{role} {name} {did} the {obj} {when}.
{name}, {role0} at {firm}, {did} the {obj}.
{name} ({firm}) {did} {n} {things}.
{beside} {name}, the {obj} was {past}.
{beside} {name} and {name} the {things} were {past} {when}.
The {obj} was {past} by {name} {when}.
The {things} are {past}, see {name}.
We {did} {name} {when}.
I {did} {name} that the {obj} was {past}.
{role}={name}
{role} - {name} - {phone}
{role}: {name} ({email})
{name} <{email}> {did} the {obj}
{name}, {phone}: the {obj} is {past}
{given} {did} the {obj} {when}
{given}, please {verb} the {obj}.
{greet} {given},
{greet} {given}, the {obj} is {past}.
{bye},\n{name}
{bye}, {given}
{bye}\n{given}
@{given} {verb} {things}
{name} / {name} / {name}
{n}. {name}
{name}: {things} {past} {when}
{name} and {name} {did} {things}
the {role0}, {name}, {did} {things}
{role} {name}, {idl} {idn}, {did} the {obj}
{idl} {idn} {when}
{name} has {idl} {idn}
{role}: {idl}: {idn}
{thing0} to {address} {when}
{role} {name}, {address}
{beside} {address} the {obj} is {past}
{role}: {phone}
{thing0} {email} {when}
{beside} {email}, {phone}
"{low}": "{name}", "{low}": "{email}"
{low}='{name}'; {low}={phone}
{low}('{name}','{firm}',{n})
- {bye}, {given}
{n}. {bye}, {given}
{bye}, {given}\n{Cap} {low} {things}
{low} {name} {low} {n} {things}
{role} {low}: {name}; {address}; {phone}
{thing0} to {address} and {low} for {name}.
{beside} {address}. {Start} {low} {things}
{low} {low} to {address}. {Start} {low}
{low}={address} {Start} {low} the {obj}
{low}={name};{low}={phone};{low}.{low}={address}
{low}({low},$,('{address}'),$,$);
{name}; {address}; {phone}
{phone} {low} {low} the {low} {role0}.
{phone} {low} to the {obj}
{low} {phone}, {low} {email}.
{role} {phone}, {low} {email}
CC {email}; {email}
{low} {email}; {email}; {email}
{role} <{email}> {did} the {obj}
{low} {low} {low} {idl} {idn}. {Start} {low}
{low} {low} {low} of {idl} {idn} in the {low}
{role}: {name}, {idl} {idn}, {low} {when}.
{name} ({idl} {idn}) {did} {n} {things}
{name} and {name} {did} {len} at the {obj}
{name} and {title}{name} {did} the {obj}
{role}: {name}, {title}{name} and the {role0}.
{role}: {title}{name}; {address}; {phone}; {email}
{low} {low} by {title}{name} and {low} {things}
{title}{name} and {name} {did} the {obj}
As {name} {low}, the {obj} {low}
{Start} {low} {name} {low} the {obj}
('{name}','{firm}','{town}')
{low} {low} {low} {name}, {address}. {Start} {low}
{Cap}={phone};{Cap}_{Cap0}.{Cap}={address}
{Cap}={address}\n{Start} {low}
{low} {low} {low} to {address}.\n{Things} {low}
{low} {low} for {title}{name}. {Cap} {low} {n} {things}
{role}: {name}, {name} and the {role0}. {Start} {low}
""",
    "de": """
{name} hat {Ding} {hat}.
{role}: {name}
{role} {name} hat {Dinge} {hat}.
{name} ({firm}) hat {Ding} {hat}
{beside} {name} wird {Ding} {hat}.
{Ding} wurde von {name} {hat}.
{Dinge} wurden {when} von {titlef}{name} {hat}.
{name} und {name} haben {Dinge} {hat}.
{greet} {given},
{greet} {titlef}{name},
{bye}\n{name}
{bye}, {given}
{given} hat {Dinge} {hat}
{role} {name}, {idl} {idn}
{idl} {idn} {when} {hat}
{name}, {idl}: {idn}
{role}: {name}, {phone}
{role} {name}, {email}
{beside} {address} {when}
{name}, {address}
{role}: {address}, {phone}
{beside} {phone} oder {email}
{name}: {Ding} {hat}
{Noun} bei {name}, {address}.
{Noun} bei {titlef}{name} {when}
{Noun} von {n} {Dinge} an {address}.
{Noun} an {address}. {Start} {low}
{Ding} {low} {low} {address}.
{Noun}: {address}
{bye}, {given}\n{Start} {low} {Ding}
{bye}, {given} {Start} {Noun} {low}
{phone} {low} zur {Noun}, {low} {Ding}
{phone} {low} {low} {Noun}
{low} {low} {phone} oder <{email}>
{idl}: {idn}, {Noun} {name}
{idl} {idn}. {Start} {low}
{role} {titlef}{name}, {idl} {idn}, {low}
{name} und {titlef}{name} haben {len} {hat}
{beside} {name} ist {Ding} {hat}.
{name} {low} {Dinge} an {Noun} {X}
{name} {low} {Ding} {when}
{role} {name} {Noun} der {Noun} {low}
{Start} {Noun} {low} {low} {address}. {Start} {Noun}
{Noun} bei {titlef}{name}, {address}. {Dinge} {low}
""",
    "fr": """
{name} a {hat} {chose}.
{role} : {name}
{role} {name} a {hat} {choses} {when}.
{name} ({firm}) a {hat} {chose}
{beside} {name}, {chose} est {hat}.
{chose} a été {hat} par {name} {when}.
{name} et {name} ont {hat} {choses}.
{greet} {given},
{greet} {titlef}{name},
{bye}\n{name}
{bye}, {given}
{given} a {hat} {choses}
{role} {name}, {idl} {idn}
{idl} {idn} {hat} {when}
{name}, {idl} : {idn}
{role} : {name}, {phone}
{role} {name}, {email}
{beside} {address} {when}
{name}, {address}
{role} : {address}, {phone}
{beside} {phone} ou {email}
{name} : {chose} {hat}
{Cap} de {name}, {idl} {idn}
{Cap} de {titlef}{name} {when}
{idl} {idn}. {Start} {low}
{Cap} {titlef}{name} au {phone}.
{low} {titlef}{name} au {phone}
{choses} {low} chez {titlef}{name}, {address}.
{chose} {low} {low} au {address}.
{Cap} de {n} {choses} au {address}
{low} {chose} à {email} {when}
{titlef}{name} {low} {choses} {low} {X}
{name} {low} {choses} {when}
{name} et {titlef}{name} ont {hat} {len}
{beside} {name}, {chose} {low} {hat}
{Start} {low} {low} au {address}. {Cap} {low} {len}
{Start} {low} {low} chez {name}, {address}. {Cap} {low}
{role} {titlef}{name} au {phone}. {Start} {low}
""",
}

PLAIN_PLANS = {
    "en": """
{firm} {did} the {obj} {when}.
{role}: {firm}
{role} {did} the {obj} {when}.
{beside} {firm}, the {things} were {past}.
{town} and {town} {did} {things}
The {obj} was {past} by {firm} {when}.
{Things} {did} the {obj}
{Things}: {n} {past}, {n} {past}
{role}: {Things}
{greet} all,
{bye},\nthe {role0}
{greet} team, the {obj} is {past}.
{beside} {town} the {obj} is {past}
the {role0} {did} {n} {things}
Please {verb} {things} {when}
{thing0} {code} {when}
{role}: {code}
{beside} {code}, {code}
{Things} {Things} {n}
{role0} {n}: {code}
I {did} that {things} were {past}.
{n} {things} of {len} {past} at {X}/{n}
{Cap} {low} {low} the {obj}.
{Cap} {low} {things} {when}.
{Cap} {things} {low} {n}
{Cap} {low} the {obj}, {low} {n} {things}.
{Cap} {low} that {things} {low}.
{Cap}: {things}, the {tool}
{Cap} {Cap0} {low} {n}
The {Cap} {low} {did} {things}.
the {Cap} {low} and the {Cap} {low} are {past}
@all {Cap} {low} the {obj}
@everyone {low} {things}
{low}.{low}("{cls}")[{n}].{low}
for {low} in {low}.{low}("{cls}"): {low}()
{low}({low}={cls}, {low}="{Cap}")
WARN {cls} {low}: {Cap}
{cls} {low} {n}
key={pcode} {low} {n}
drawing {pcode}, order {pcode}
Serial {pcode} {low} {when}
order {pcode} {low} part {pcode}
{low} {pcode}
{n}. {Cap} {low} {low}
{Cap} {low}. {Cap} {low} {low}. {Cap} {low}.
In {Cap} {low}, {n} {things} {low}
{Cap} {low} {obj}; {low} {things}
{Things} {low} {X}. {Cap} {low} {n}
Will {verb} the {obj} and {things} {when}.
Will {verb} {things} {low}.
May {verb} the {obj} {when}.
Mark {things} and {verb} the {obj}.
{Cap} {low} {things} {low} {X}. {Cap}
{Cap} {low}, {n} {low} {things} in {low} {X}. {Cap} {low}, {n}
{Start} a {obj} {low} no {low}, {low} {things}.
{Start} a {low} {low} {low} {low} the {obj}
{Start} {low} the {obj}: {low} {low}
{Start} {low} {things} {low}.
{Start} a {low} of {code} in the {low}
{things} {low} {low} {X}. {Start} {low} the {obj}
{low} next to {low} {X}. {Start} {low} {low}
{n} W/m²K. {Start} a {low}
A {low}-{low} {low} of the {obj} {low} {n} {cls}
A {low}-{low} {low}, {low} {things}
{street} {low} {obj}, {low} {n}, {low}
{street} {low} {low} {n} {things}
{low} {low}={n} [+ {cls}], {low}="{X}{n}"
{low} {low}='{X}-{n}' [+ {cls}]
{Things} {low} the {low}
{Cap} {low} {low} the {obj} {low} {n}
{Cap} {low} on the {obj}
{firm0} {low} item {code} at {n}
{low}('{firm0}','{firm}',$)
{Cap}: {low} {low}, the {tool}
{code} {low} {low} {n} {things}
{role} {low} {low} the {obj}
{len} between {low} {low} and {low} {low}; the {low} {low} {len}
{low} {low}, {low} {low} and {low} {low} {low}
the {low} {low}; {low} {low} {low}
{Start} {low} that the {low} {low} {low} the {low}
{Cap} number {code}, {low} {code}
{low} number {code}, {low} {code}. {Start} {low}
{things} {low} grid {X}. {Cap} {low} the {obj}
{low} zone {X}. {Cap} of {len} {low}
{street} {low} {obj}, bay {n}
{Cap} {things} {low} the {obj}
""",
    "de": """
{firm} hat {Ding} {hat}.
{role}: {firm}
Die {role} hat {Dinge} {hat}.
{beside} {firm} wird {Ding} {hat}.
{Dinge} wurden {when} {hat}.
{beside} {town} werden {Dinge} {hat}.
{role}: {code}
{greet} zusammen,
{Dinge} und {Dinge} {hat} {when}
{Ding} und {Ding}: {n} {hat}
{beside} {code} {when}
Bitte {Ding} {when} {hat} lassen
{Cap} {low} den {Noun}, {low} {Ding} {low}.
{Noun} fehlt bei {n} {Dinge}.
Der {Noun} {low} die {Noun} {low}
{n} {Noun} im {Noun} {n}
{Noun}, {Noun} und {Noun}
Das {Noun} {low} jeden {Noun} über {len}
{Cap} {low} {Dinge} {low} {when}
Die {Noun} der {Noun} ist {hat}, {low} der {Noun} {low}.
Zum {Noun} {low} {n} {Dinge}
@alle {Cap} {low} {Ding}
Auftrag {pcode}, Plan {pcode}
{Cap} {low} {Dinge} {low} {X}. {Cap} {low}
{letter} für {Ding} {hat}
{Start} {letter} für {Noun} {hat}, {low} {Ding} {low}.
{Noun} {low} den {letter}, {low} {low}
{letter} und {letter}: {n}
{Start} {low} {Ding} {low}
{Start} {Noun} {low} {Dinge} {low}.
{Noun} in Zone {X}. {Noun} an {Noun} {X}/{n} {low}
{low} {Noun} {X}. {Start} {Noun} {low}
{Noun} an {Noun} {X}/{n} müssen {low}
{Noun}, {Noun}\n{low} {low}. {Start}, {low}
{Noun} an {firm} {when}
{Noun} der {Dinge}: im {Noun} {n}, {Noun} {len}.
{Noun} {low} {Noun}: unter dem {Noun}, {Noun} {len}
{Noun}: an der {Noun}, {Noun} {len}. {Start} {low}
{Ding} neben {Noun} {n}, {Noun} {len}
{Noun} {n}, {Noun} {len}, {Noun} {n}
""",
    "fr": """
{firm} a {hat} {chose}.
{role} : {firm}
{role} a {hat} {choses} {when}.
{beside} {firm}, {chose} est {hat}.
{beside} {town}, {choses} sont {hat}.
{role} : {code}
{greet} à tous,
{choses} et {choses} {hat} {when}
{beside} {code} {when}
Merci de revoir {chose} {when}
{Cap} {low} {chose} {low}.
{Cap}, {chose} {low} {when}
{Cap} {low} {low} {n} {choses}
@tous {Cap} {low} {chose}
{Cap} de {low} : {n} {choses} à {len}
commande {pcode}, plan {pcode}
{Cap} {low} {choses} {low} {X}. {Cap} {low}
Le {low} {Cap} {low} {when}
{Start}, {chose} {low} {low}.
{Start} {low} {chose} {low} {when}
{Cap} d'{low} {low} {low} {X}
{Cap} d'{low} en {low} {n}
{Start}'au {low} {low}, {chose} {low}
{choses} : {low}. {Start}, {chose}
{Cap} de {low}, {low} {n}
{firm0} {low} {n} {choses}
{Cap} de {Cap0} {low} {n}
{chose} à {low} {n}, {low} {len}, {low} {X}{n}
""",
}

#: Words of the sentence plans by language.
PLAN_WORDS = {
    "en": {
        "did": "asked|told|checked|moved|found|signed|reported|confirmed|explained|called|visited|left|wants|needs|noticed|measured|rejected|drew|sent|answered|opened|stopped|wrote about|looked at|complained about|is waiting for|has seen|forgot|owns|knows",
        "role": "Foreman|Client|Engineer|Surveyor|Planner|Driver|Guard|Reporter|Assignee|Reviewer|Inspector|Guest|Witness|Tenant|Owner|Architect|Electrician|Welder|Contact|Name|Person|Responsible|Approved|Editor|Sender|Recipient|Present|Absent|Caller",
        "role0": "foreman|client|engineer|surveyor|planner|driver|inspector|tenant|architect|electrician|welder|editor|caller|plumber|coordinator|neighbour",
        "beside": "According to|With|For|From|By|Thanks to|After|Together with|Due to|Per|At|Near|Without|Besides|Like|Via|See|Ask|Call|About",
        "when": "today|yesterday|on Monday|in week 12|before noon|last month|again|twice|on site|after lunch|at the gate|in the office|during the walk|next year|by Friday|without notice",
        "Start": "Nobody|Somebody|Everyone|Nothing|Suppose|Checked|If|When|While|Once|Since|Unless|Because|Although|After|Before|Until|Whenever|It|Which|What|Why|How|Every|Each|Some|No|Both|Explain|Describe|Compare|Please|Set|Put|Keep|Fixed|Found|Lost|Seen|Sent|Test|Draft|Trial|Try|Attempt|Note|New|Old|Also|Then|Now|Here|There|Monday|Tuesday|Wednesday|Thursday|Friday|March|August",
        "greet": "Hi|Hello|Dear|Good morning|Morning|Hey|Good afternoon", "bye": "Best regards|Regards|Thanks|Cheers|Best|Sincerely|Greetings|Yours|Many thanks|BR",
        "thing0": "Send it|Deliver everything|Forward this|Copy|Write|Drive|Ship the crate|Come|Return the keys|Post it",
    },
    "de": {
        "hat": "geprüft|bestellt|versetzt|gemeldet|gezählt|abgelehnt|geliefert|gestrichen|vermessen|freigegeben|entfernt|gefunden|vergessen|erklärt|ersetzt|verschoben",
        "role": "Polier|Bauherr|Planerin|Prüfer|Fahrer|Vermieter|Elektriker|Kontakt|Name|Verantwortlich|Bearbeiter|Absender|Empfänger|Gast|Zeuge|Sachbearbeiterin|Anwesend|Vertreter|Inhaber|Eigentümerin|gez.|Gez.",
        "beside": "Laut|Mit|Für|Von|Bei|Nach|Über|Ohne|Durch|Siehe|Gegenüber|Wegen", "when": "heute|gestern|am Montag|nächste Woche|vor Ort|erneut|am Tor|ohne Grund|im Büro|zweimal",
        "Start": "Wenn|Falls|Da|Weil|Seit|Nach|Vor|Der|Die|Das|Ein|Eine|Kein|Jede|Danach|Dann|Hier|Dort|Diese|Dieser|Bitte|Es|Wer|Wie|Warum|Erkläre|Begründe|Nenne|Montag|Dienstag|Mittwoch|Freitag|Angenommen|Ohne|Beim|Neue|Alte",
        "greet": "Hallo|Guten Tag|Lieber|Liebe|Moin|Guten Morgen", "bye": "Viele Grüße|Beste Grüße|Grüße|Gruß|Gruß|Schöne Grüße|Mit bestem Gruß|Freundliche Grüße|Danke|LG|MfG|Herzlich",
    },
    "fr": {
        "hat": "vérifié|commandé|déplacé|signalé|compté|refusé|livré|peint|mesuré|validé|retiré|trouvé|oublié|expliqué|remplacé|repoussé",
        "role": "Conducteur|Client|Ingénieur|Contrôleur|Chauffeur|Bailleur|Électricien|Contact|Nom|Responsable|Rédacteur|Expéditeur|Destinataire|Invité|Témoin|Présent|Absent|Gardien",
        "beside": "Selon|Avec|Pour|De|Chez|Après|Par|Sans|Voir|Face à|Contacter|Vers", "when": "aujourd'hui|hier|lundi|la semaine prochaine|sur place|encore|à l'entrée|sans raison|au bureau|deux fois",
        "Start": "Si|Quand|Lorsque|Depuis|Après|Avant|Le|La|Les|Un|Une|Ce|Cette|Ces|Puis|Ensuite|Ici|Chaque|Il|Elle|Voir|Jusqu|Aujourd|Quoique|Merci|Lundi|Mardi|Mercredi|Jeudi|Vendredi|Samedi|Dans|Sur|Nouvelle|Pourquoi|Expliquer",
        "greet": "Bonjour|Bonsoir|Cher|Chère|Salut|Madame", "bye": "Cordialement|Bien à vous|Merci|Salutations|Amicalement|À bientôt|Sincères salutations",
    },
}

#: Identity numbers by language: brace of the label and brace of the number.
_IDS = {"en": [("ssnl", "ssn"), ("ninol", "nino"), ("passl", "passport"), ("taxl", "ssn")], "de": [("steuerl", "steuer"), ("ausweisl", "ausweis"), ("ausweisl", "passport")], "fr": [("nirl", "nir"), ("passfr", "passport")]}

#: Words for the braces.
WORDS = {
    "things": "bolts|hinges|panels|ducts|pumps|radiators|tiles|windows|dampers|joists|rafters|lamps|switches|pipes|plates|posts|railings|sensors|stairs|gutters|cables|doors|beams|walls|columns|slabs|openings|spaces|fixtures|drawings",
    "Things": "Bolts|Hinges|Panels|Ducts|Pumps|Tiles|Windows|Joists|Rafters|Pipes|Posts|Sensors|Stairs|Cables|Doors|Beams|Walls|Slabs|Openings|Spaces",
    "obj": "roof|north wall|stair core|lift shaft|entrance door|ring beam|ground floor slab|footing|manhole|plant room|ceiling grid|ventilation duct|fire door|ramp|facade|parapet|retaining wall|truss|Oak door|Steel frame|Granite step|pile|canopy|kitchen|boiler|handrail|water main",
    "tool": "viewer|importer|scheduler|clash check|parser|converter|validator|take-off script|plug-in|renderer|build server|license manager",
    "past": "moved|closed|painted|measured|checked|deleted|copied|approved|rejected|installed|raised|cut|renamed|hidden|dropped|split|cleaned|counted|shifted|repaired",
    "verb": "move|close|paint|measure|check|delete|copy|approve|reject|install|raise|cut|rename|hide|split|clean|count|repair|draw|order",
    "place": "library|station|warehouse|theatre|hospital|car park|museum|laboratory|harbour office|stadium|town hall|depot",
    "Ding": "die Decke|das Dach|der Träger|die Tür|das Fenster|die Treppe|der Schacht|die Wand|das Fundament|der Estrich|die Rampe|Stahlstütze|Deckenplatte|Außenwand|Brandschutztür|Lüftungskanal|das Geländer",
    "Dinge": "Türen|Fenster|Stützen|Rohre|Kabel|Fliesen|Träger|Platten|Schrauben|Lampen|Heizkörper|Pumpen|Wände|Decken|Treppen|Geländer",
    "chose": "la toiture|le plancher|la porte|la fenêtre|l'escalier|la gaine|le mur|la fondation|la chape|la rampe|Poteau métallique|Mur extérieur|Porte coupe-feu|le garde-corps|la poutre|le plafond",
    "choses": "portes|fenêtres|poteaux|tuyaux|câbles|carreaux|poutres|plaques|vis|lampes|radiateurs|pompes|murs|planchers|escaliers|luminaires",
    "attr": "fire rating|description|tag|phase|load class|finish|room number|object type|thermal value|owner history|layer|unit",
    "cls": "IfcWall|IfcSlab|IfcDoor|IfcBeam|IfcColumn|IfcSpace|IfcWindow|IfcStair|IfcMember|IfcPipeSegment",
    "firm": "Alpine Glazing Ltd|Harbour & Sons|Delta Steel Inc|Holzbau Nord GmbH|Brenner AG|Atelier Rive Gauche SARL|Weaver Pumps plc|Carpenter Brothers Ltd|Lumen Electric|Gebr. Sander KG|Stone Craft Ltd|Baker Lifts GmbH|Menuiserie du Lac SA|Fischer Aufzüge GmbH",
    "town": "Eastford|Millbrook|Greyhaven|Lindau|Altenried|Seefeld|Beaumont|Clairval|Rivemont|Northwick|Steinach|Villeneuve",
    "ssnl": "social security number|SSN|Social Security No.|SSN:|social security no.|SSN no.",
    "ninol": "national insurance number|NI number|NINO|NI no.|National Insurance no.|NINO:",
    "taxl": "tax number|tax ID|TIN|tax id:",
    "passl": "passport|passport number|passport no.|ID card|identity card no.|Passport:",
    "passfr": "le passeport|passeport n°|la carte d'identité|carte d'identité n°",
    "steuerl": "Steuer-ID|Steueridentifikationsnummer|steuerliche Identifikationsnummer|steuerliche Identifikationsnummer:|steuerliche ID:|Steuer-IdNr.|Steuernummer|IdNr.|Steuer-Nr.|Steuer-ID:",
    "ausweisl": "Personalausweis|Ausweisnummer|Reisepass|Ausweis Nr.|Passnummer|Personalausweis-Nr.",
    "nirl": "numéro de sécurité sociale|NIR|n° de sécurité sociale|numéro de sécurité sociale :|numéro INSEE|n° sécu|n° de sécu|numéro fiscal",
}

#: Common given names and family names of several languages, some of which are plain words too.
GIVEN = """
James Mary John Linda Robert Susan Michael Karen David Nancy Thomas Sarah Daniel Laura Mark Emily Paul Rachel Steven Helen Andrew Alice George Ruth Kevin Grace
Peter Hans Klaus Sabine Katharina Jürgen Monika Stefan Ursula Wolfgang Heike Uwe Birgit Matthias Anja Lukas Hannah Günther Käthe Jörg
Jean Marie Pierre Isabelle Michel Sylvie Philippe Nathalie Alain Chloé François Élise Thierry Céline Gérard Hélène Benoît Amélie
Giulia Marco Sofia Diego Carmen João Inês Piotr Agnieszka Katarzyna Jan Eva Søren Ingrid Bjørn Astrid Ayşe Mehmet Olga Ivan Dmitri Yuki Kenji Mei Wei Priya Arjun Fatima Omar Amina Kwame Chinedu Zainab Rosa Will May Rose Frank Bill Hope Dean Joy Sue Art
""".split()
FAMILY = """
Smith Johnson Brown Taylor Wilson Thompson Walker White Hughes Edwards Green Hall Clark Stone Mason Wood Hill Field Carpenter Baker Wall Marsh
Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Schäfer Koch Bauer Richter Klein Wolf Schröder Neumann Vogel Zimmermann Krüger Köhler
Martin Bernard Dubois Thomas Robert Petit Durand Leroy Moreau Laurent Lefebvre Michel Garcia Roux Fournier Girard Lambert Mercier
Rossi Bianchi Silva Santos Fernández López Nowak Kowalska Novák Horváth Jensen Lindqvist Eriksen Yılmaz Kaya Ivanov Petrov Tanaka Sato Nguyen Chen Patel Singh Khan Okonkwo Mensah Diallo Haddad
""".split()
_ONSET = "b br c ch d dr f fl g gr h j k kl l m n p pr r s sch sl st t tr v w z".split()
_VOWEL = "a e i o u a e o ai ei ou ie ö ü é".split()
_CODA = "n r l s t m nd rt ck ng ll ss th".split()
_TAIL = "son ski mann berg feld ov enko ez ini sen stad ard eau ier ington ley croft well ham etti aki oglu dal bach holm".split()


def _sounds(r: random.Random, n: int) -> str:
    return "".join(r.choice(_ONSET) + r.choice(_VOWEL) + (r.choice(_CODA) if r.random() < 0.35 else "") for _ in range(n))


def _given(r: random.Random) -> str:
    """A listed name or one made up from sounds."""
    g = r.choice(GIVEN) if r.random() < 0.5 else (_sounds(r, r.choice([1, 2, 2])) + r.choice(["", "a", "e", "o", "n", "us"])).capitalize()
    return f"{g}-{r.choice(GIVEN)}" if r.random() < 0.03 else g


def _family(r: random.Random) -> str:
    s = r.choice(FAMILY) if r.random() < 0.4 else (_sounds(r, r.choice([1, 1, 2])) + (r.choice(_TAIL) if r.random() < 0.7 else "")).capitalize()
    x = r.random()
    if x < 0.05:
        s += "-" + r.choice(FAMILY)
    elif x < 0.09:
        s = r.choice(["O'", "Mc", "D'", "L'"]) + s
    elif x < 0.17:
        s = r.choice(["von ", "van ", "van den ", "de ", "de la ", "le ", "el-", "di ", "von der ", "ten "]) + s
    return s.upper() if r.random() < 0.08 else s


#: Forms of address by language; those of "titlef" stand before a name in any frame.
TITLES = {
    "en": ["Mr ", "Mr. ", "Mrs ", "Mrs. ", "Ms ", "Ms. ", "Dr ", "Dr. ", "Prof. "],
    "de": ["Herr ", "Frau ", "Herrn ", "Dr. ", "Prof. Dr. ", "Frau Dr. "],
    "fr": ["M. ", "Mme ", "Mlle ", "Monsieur ", "Madame ", "Dr "],
}


def _name(r: random.Random, after_title: bool) -> str:
    g, f, x = _given(r), _family(r), r.random()
    if after_title and x < 0.5:
        return f
    if x < 0.58:
        return f"{g} {f}"
    if x < 0.66:
        return f"{g} {r.choice('ABCDEFGHJKLMNPRSTW')}. {f}"
    if x < 0.75:
        return f"{g[0]}. {f}"
    if x < 0.88:
        return f"{f}, {g}"
    if x < 0.92:
        return f"{g} {f}".lower()
    if x < 0.96:
        return f"{f} {g}"
    return f"{g} {f}".upper()


def _d(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _email(r: random.Random) -> str:
    plain = lambda s: re.sub(r"[^a-z]", "", s.lower()) or "x"
    g, f = plain(_given(r)), plain(_family(r))
    local = r.choice([f"{g}.{f}", f"{g}_{f}", f"{g}-{f}", f"{g[0]}.{f}", f"{g}{_d(r, 2)}", g, f, f"{f}+{plain(_sounds(r, 1))}", f"{g}.{f}+{plain(_sounds(r, 1))}", f"{g[0]}{f}", f"{f}_{_d(r, 2)}", g.capitalize(), r.choice(["info", "office", "sales", "team", "support"]) + r.choice(["", _d(r, 1)])])
    host = r.choice([plain(_sounds(r, 2)), plain(_sounds(r, 2)) + "-" + r.choice(["bau", "group", "ing", "design"]), f"mail.{plain(_sounds(r, 2))}"])
    domain = host + "." + r.choice(["com", "org", "net", "de", "fr", "co.uk", "eu", "example", "test", "invalid", "info"])
    x = r.random()
    if x < 0.5:
        return f"{local}@{domain}"
    if x < 0.6:
        return f"{local} @ {domain}"
    if x < 0.65:
        return f"{local}@{domain}".upper()
    a, b = r.choice("([{ "), ""
    b = {"(": ")", "[": "]", "{": "}", " ": " "}[a]
    word = lambda s: f"{a}{s}{b}" if a == " " or r.random() < 0.5 else f" {a}{s}{b} "
    at = word(r.choice(["at", "at", "AT", "ät"]))
    return local + at + (domain.replace(".", word(r.choice(["dot", "dot", "DOT", "punkt"]))) if r.random() < 0.7 else domain)


def _groups(r: random.Random, sizes: list[int], seps: str = " -.") -> str:
    return r.choice(seps).join(_d(r, n) for n in sizes)


def _phone(r: random.Random) -> str:
    """A number by one of the usual national groupings, with a country code, trunk zero, brackets or none."""
    x = r.random()
    if x < 0.22:
        area, rest = _d(r, 3), _groups(r, [3, 4], "-. ")
        s = r.choice([f"({area}) {rest}", f"{area}-{rest}", f"{area}.{rest.replace('-', '.')}", f"+1 {area} {rest}", f"1-{area}-{rest}", f"+1{area}{_d(r, 7)}", f"+1 ({area}) {rest}"])
        return s + (f" {r.choice(['ext.', 'x', 'ext'])} {_d(r, r.choice([2, 3, 4]))}" if r.random() < 0.15 else "")
    if x < 0.45:
        body = r.choice([_d(r, 2) + " " + _groups(r, [4, 4], " "), _d(r, 3) + " " + _groups(r, [3, 4], " "), _d(r, 4) + " " + _d(r, 6)])
        return r.choice([f"+44 {body}", f"+44 (0){body}", f"0{body}", f"0044 {body}", f"(0{body.replace(' ', ') ', 1)}", "+44" + body.replace(" ", "")])
    if x < 0.72:
        area, rest = str(r.randint(2, 9)) + _d(r, r.choice([1, 2, 3])), _d(r, r.choice([5, 6, 7, 8]))
        rest = rest if r.random() < 0.5 else f"{rest[:-3]}{r.choice([' ', '-'])}{rest[-3:]}"
        return r.choice([f"+49 {area} {rest}", f"+49 (0){area} {rest}", f"0{area} {rest}", f"0{area}/{rest}", f"0{area}-{rest}", f"0049 {area} {rest}", f"(0{area}) {rest}", f"+49{area}{rest}"])
    tail = [_d(r, 2) for _ in range(4)]
    sep = r.choice([" ", " ", ".", "-", ""])
    first = str(r.randint(1, 9))
    return r.choice([f"0{first}{sep}{sep.join(tail)}", f"+33 {first} {' '.join(tail)}", f"+33 (0){first} {' '.join(tail)}", f"0033 {first} {' '.join(tail)}", f"+33{first}{''.join(tail)}"])


def _identity(r: random.Random, kind: str) -> str:
    upper = "ABCDEFGHJKLMNPRSTVWXYZ"
    if kind == "ssn":
        a, b, c = _d(r, 3), _d(r, 2), _d(r, 4)
        return r.choice([f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", a + b + c])
    if kind == "nino":
        p, n, e = r.choice(upper) + r.choice(upper), _d(r, 6), r.choice("ABCD")
        return r.choice([f"{p} {n[:2]} {n[2:4]} {n[4:]} {e}", f"{p}{n}{e}", f"{p} {n} {e}"])
    if kind == "passport":
        return r.choice([_d(r, 9), r.choice(upper) + _d(r, 8), r.choice(upper) + r.choice(upper) + _d(r, 7), f"{r.choice(upper)}{_d(r, 2)}{r.choice(upper)}{r.choice(upper)}{_d(r, 4)}", f"{_d(r, 2)}{r.choice(upper)}{r.choice(upper)}{_d(r, 5)}", f"{r.choice(upper)}{_d(r, 1)} {_d(r, 3)} {_d(r, 3)}"])
    if kind == "steuer":
        n = _d(r, 11)
        return r.choice([n, f"{n[:2]} {n[2:5]} {n[5:8]} {n[8:]}", f"{n[:3]}/{n[3:6]}/{n[6:]}"])
    if kind == "ausweis":
        return r.choice(upper) + "".join(r.choice("0123456789CFGHJKLMNPRTVWXYZ") if r.random() < 0.6 else _d(r, 1) for _ in range(8))
    n = (r.choice("1278") if r.random() < 0.6 else _d(r, 1)) + _d(r, 14)
    return r.choice([n, f"{n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:10]} {n[10:13]} {n[13:]}", f"{n[0]} {n[1:3]} {n[3:5]} {n[5:7]} {n[7:10]} {n[10:13]}"])


#: Kinds of ways.
_WAYS = {
    "en": "Street St St. Road Rd Lane Avenue Ave Close Court Drive Way Place Row Terrace Gardens Square Quay Crescent Hill Walk Gate".split(),
    "de": "straße str. weg gasse allee platz ring damm ufer".split(),
    "fr": "rue avenue boulevard quai place chemin impasse allée route cours".split(),
}


def _address(r: random.Random, lang: str) -> str:
    town = _sounds(r, r.choice([1, 2])).capitalize() + r.choice(["", "", "ford", "ham", "burg", "hausen", "ville", "mont", " am See", "-les-Bains", *{"en": [" Green", " Heath", " Cross", " Park", " Bridge"], "de": [" am Main", " im Tal"], "fr": ["-sur-Mer", "-le-Vieux"]}[lang]])
    number = f"{r.randint(1, 250)}{r.choice(['', '', '', '', 'a', ' b', 'B'])}"
    word = _sounds(r, r.choice([1, 2])).capitalize() if r.random() < 0.7 else r.choice(["Station", "Church", "Mill", "Park", "Old Mill", "High", "King's", "Long", "River"])
    if lang == "en" and r.random() < 0.25:
        word += r.choice([" Hill", " Park", " Mill", " Dock", " Bridge", " Field", " Wood"])
    if lang == "de":
        way = r.choice(_WAYS["de"])
        street = r.choice([f"{word}{way}", f"{word}{way}", f"{word}er {way.capitalize()}", f"{r.choice(['Am', 'An der', 'Auf dem', 'Im', 'Zum', 'Unter den', 'Alte', 'Am Neuen', 'Am Alten', 'Zur Hohen', 'Am Kleinen'])} {r.choice([_sounds(r, 2).capitalize(), 'Markt', 'Bahnhof', 'Kirchplatz', 'Mühlbach', 'Wald', 'Tor', 'Brücke'])}"])
        s = f"{street} {number}" if r.random() < 0.9 else f"Postfach {_groups(r, [2, 2, 2][: r.choice([2, 3])], ' ')}"
        return s + ("" if r.random() < 0.3 else f", {_d(r, 5)} {town}")
    if lang == "fr":
        n = f"{r.randint(1, 250)}{r.choice(['', '', '', ' bis', ' ter'])}"
        of = r.choice(["de la ", "du ", "des ", "de l'", "de ", ""])
        word += r.choice(["", "", f" {r.choice(['Blancs', 'Verts', 'Neuf', 'Haut'])}"])
        s = f"{n}{r.choice([' ', ', '])}{r.choice(_WAYS['fr'])} {of}{word}{r.choice(['', '', ' ' + _sounds(r, 1).capitalize()])}" if r.random() < 0.9 else f"{r.choice(['BP', 'B.P.', 'Boîte postale'])} {_d(r, r.choice([2, 3, 4]))}"
        return s + ("" if r.random() < 0.3 else f", {_d(r, 5)} {town}")
    s = f"{number} {word} {r.choice(_WAYS['en'])}"
    x = r.random()
    if x < 0.2:
        s = f"{r.choice(['Flat', 'Unit', 'Suite', 'Apt', 'Apartment', 'Floor'])} {r.randint(1, 60)}, {s}"
    elif x < 0.32:
        s = f"{r.choice(['PO Box', 'P.O. Box', 'P O Box'])} {r.randint(10, 9999)}"
    code = r.choice([f"{r.choice('ABCEGLMNRSW')}{r.choice(['', *'ABDEHLNRST'])}{r.randint(1, 20)} {r.randint(1, 9)}{r.choice('ABDEFGHJ')}{r.choice('LNPQRSTUWXYZ')}", _d(r, 5), f"{r.choice(['CA', 'NY', 'TX', 'OH', 'WA'])} {_d(r, 5)}"])
    return s + r.choice(["", "", f", {town}", f", {town} {code}", f", {town}, {code}"])


#: Parts of German compound nouns.
_NOUN_A = "Bau Dach Wand Stahl Licht Luft Wasser Brand Schall Boden Fenster Netto Bezugs Raum Plan Tür Decken Last Netz Geschoss Kabel Rohr Treppen Material Kenn".split()
_NOUN_B = "schutz höhe wert liste plan zuordnung schicht menge fläche nummer name teil kanal maß prüfung art klasse lage zeichen weg volumen punkt".split()


def _guid(r: random.Random) -> str:
    h = "".join(r.choice("0123456789abcdef") for _ in range(32))
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


def _filled(r: random.Random, key: str, lang: str, after_title: bool) -> tuple[str, str | None]:
    """(text, kind or None) of a brace."""
    if key == "name":
        return _name(r, after_title), "name"
    if key == "given":
        return _given(r), "name"
    if key == "email":
        return _email(r), "email"
    if key == "phone":
        return _phone(r), "phone"
    if key == "address":
        return _address(r, lang if r.random() < 0.7 else r.choice(list(FRAMES))), "address"
    if key in ("ssn", "nino", "passport", "steuer", "ausweis", "nir"):
        return _identity(r, key), "id_number"
    if key in ("title", "titlef"):
        return (r.choice(TITLES[lang]) if key == "titlef" or r.random() < 0.5 else ""), None
    if key == "n":
        return str(r.randint(1, r.choice([9, 60, 900]))), None
    if key == "X":
        return r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ"), None
    if key == "x":
        return f"{r.choice(['', '-'])}{_d(r, r.choice([1, 3, 6]))}.{_d(r, r.choice([1, 2, 4]))}", None
    if key == "len":
        return f"{r.choice([str(r.randint(1, 400)), f'{r.randint(1, 90)}.{_d(r, 2)}', f'{r.randint(1, 90)},{_d(r, 1)}'])} {r.choice(['mm', 'cm', 'm', 'metres'])}", None
    if key in ("Cap", "Cap0", "low"):
        w = _sounds(r, r.choice([1, 2, 2, 3])) if r.random() < 0.5 else r.choice(WORDS[r.choice(["things", "past", "verb"] if lang == "en" else ["Dinge"] if lang == "de" else ["choses"])].split("|") + PLAN_WORDS[lang].get("hat", PLAN_WORDS["en"]["did"]).split("|"))
        w = w.split()[0]
        return (w.lower() if key == "low" else w.capitalize()), None
    if key == "letter":
        return f"{r.choice('ABCDEFGHIKLMNPRSTUVWXYZ')}-{r.choice(['Wert', 'Mail', 'Profil', 'Träger', 'Stück', 'Anteil', 'Achse', 'Plan', r.choice(_NOUN_A) + r.choice(_NOUN_B)])}", None
    if key == "street":
        return f"{_sounds(r, r.choice([1, 2])).capitalize()}{r.choice(['', '', ' Hill', ' Park', ' Mill'])} {r.choice(_WAYS['en'])}", None
    if key == "firm0":
        return f"{r.choice([_sounds(r, 2).capitalize(), 'Atelier', 'Studio', 'Bureau', 'Groupe'])} {r.choice([_sounds(r, 2).capitalize(), 'Glass', 'Pumps', 'Steel', 'Bau', 'Lifts', 'Timber'])}", None
    if key == "Noun":
        return r.choice(_NOUN_A) + r.choice(_NOUN_B), None
    if key == "pcode":
        return r.choice("ABCDEFGHKLMNPQRSTVX") + r.choice("ABCDEFGHKLMNPQRSTVX") + _d(r, r.choice([6, 7, 7, 8])), None
    if key == "guid":
        return _guid(r), None
    if key == "gid":
        return "".join(r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_$") for _ in range(22)), None
    if key == "code":
        u = "ABCDEFGHKLMNPRSTVX"
        return r.choice([f"{r.choice(u)}-{_d(r, r.choice([3, 5, 8]))}", f"{r.choice(u)}{r.choice(u)}-{_d(r, 4)}-{r.choice(u)}", f"{_d(r, 3)}-{_d(r, 2)}-{_d(r, 4)}", f"{_d(r, 4)}/{_d(r, 3)}", _d(r, r.choice([5, 7, 9, 10])), f"{r.choice(u)}{r.choice(u)}{r.choice(u)}{_d(r, 6)}", f"{_d(r, 3)} {_d(r, 3)} {_d(r, 4)}", f"{_d(r, 3)}-{_d(r, 6)}"]), None
    if key[0] == "d" and key[1:].isdigit():
        return _d(r, int(key[1:])), None
    return r.choice((PLAN_WORDS[lang].get(key) or WORDS[key]).split("|")), None


_PART = re.compile(r"\{([a-zA-Z]+\d?)\}|([^\W\d_]{3,})|(.)", re.S)
#: Share of a frame's plain words whose place is taken by another plain word or one made up from sounds.
SWAPPED = 0.25


def _frames(source: dict[str, str], part: str) -> list[tuple[str, str]]:
    """(language, frame) of ``train`` or ``test``: every sixth frame, by a hash of its text, is kept for tests."""
    lines = [(lang, t.replace("\\n", "\n")) for lang, block in source.items() for t in block.strip().split("\n")]
    return [x for x in lines if part == "all" or (zlib.crc32(x[1].encode()) % 6 == 0) == (part == "test")]


def labelled_rows(rows: int, seed: int = 7, part: str = "all") -> list[tuple[str, list[tuple[int, int, str]]]]:
    """(text, [(start, end, kind)]) rows of the table, ``rows`` in all; the same for the same arguments."""
    return [(t, spans) for t, spans, _ in languaged_rows(rows, seed, part)]


def languaged_rows(rows: int, seed: int = 7, part: str = "all") -> list[tuple[str, list[tuple[int, int, str]], str]]:
    """``labelled_rows`` with the language of each row."""
    r = random.Random(seed)
    sources = [_frames(FRAMES, part), _frames(PLAIN, part)]
    plans = [] if part == "test" else [_frames(PLANS, "all"), _frames(PLAIN_PLANS, "all")]
    pool = {lang: sorted({w for x, t in _frames(FRAMES, "train") + _frames(PLAIN, "train") if x == lang for w in re.findall(r"(?<![{\w])[a-zäöüéèàç]{4,}(?![}\w])", t)}) for lang in FRAMES}
    before = ["", "", "", "", "", "- ", "* ", "> ", "1) ", "07:45 ", "[ok] ", "2.1 "]
    out = []
    for _ in range(rows):
        text, spans = r.choice(before), []
        lang = None
        for m in range(r.choice([1, 1, 2, 3])):
            plain = r.random() > 0.62
            source = (plans if plans and r.random() < 0.5 else sources)[plain]
            if lang is not None and r.random() < 0.8:
                source = [x for x in source if x[0] == lang] or source
            tongue, frame = r.choice(source)
            lang = lang or tongue
            label, number = r.choice(_IDS[tongue])
            frame = frame.replace("{idl}", f"{{{label}}}").replace("{idn}", f"{{{number}}}")
            text += r.choice(["\n", " ", "\n\n", " "]) if m else ""
            shout = str.upper if plain and r.random() < 0.06 else str.title if plain and r.random() < 0.06 else None
            ahead = ""
            for key, word, other in _PART.findall(frame):
                kind = None
                if key:
                    piece, kind = _filled(r, key, tongue, ahead in ("title", "titlef") and bool(piece))
                    ahead = key
                elif word:
                    piece = (r.choice(pool[tongue]) if r.random() < 0.5 else _sounds(r, 2)) if word.islower() and r.random() < SWAPPED else word
                    ahead = ""
                else:
                    piece, ahead = other, ahead if other == " " else ""
                if shout:
                    piece = shout(piece)
                if kind:
                    spans.append((len(text), len(text) + len(piece), kind))
                text += piece
        out.append((text, spans, lang))
    return out
