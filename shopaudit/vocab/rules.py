"""Wording, patterns and signatures of the nine checks (EN, DE, FR, IT, ES, NL)."""
from __future__ import annotations

from .crawl import LEGAL_SLUGS, LEGAL_TEXT, terms

LOCALES = ["en", "de", "fr", "it", "es", "nl"]

# Withdrawal function - action wording, action paths, forms to download, withdrawal by e-mail.
WITHDRAWAL_ACTION = terms("""
    withdraw from contract, withdraw from the contract, withdraw from your contract, withdraw from purchase,
    withdraw from the purchase, withdraw from order, withdraw from the order, withdraw now, withdraw here,
    exercise right of withdrawal, exercise your right of withdrawal, exercise my right of withdrawal,
    submit withdrawal, declare withdrawal, online withdrawal,
    vertrag widerrufen, vertrag hier widerrufen, hier widerrufen, jetzt widerrufen, online widerrufen,
    widerruf erklaren, widerruf hier erklaren, widerruf absenden, widerrufen,
    se retracter, me retracter, se retracter du contrat, retracter le contrat,
    exercer mon droit de retractation, exercer votre droit de retractation, envoyer ma retractation,
    recedi dal contratto, recedere dal contratto, recedi qui, esercita il diritto di recesso,
    esercitare il diritto di recesso, invia recesso,
    desistir del contrato, desistir aqui, ejercer el derecho de desistimiento, ejercer mi derecho de desistimiento,
    overeenkomst herroepen, herroep de overeenkomst, overeenkomst hier herroepen, herroep hier, herroepen""")
WITHDRAWAL_ACTION_SLUGS = terms("""
    withdraw, withdraw from contract, withdrawal request, withdrawal form online,
    widerrufen, widerruf erklaren, widerruf erklaeren, widerruf online, online widerruf,
    retracter, retractation en ligne, recedere, recesso online, desistir, herroepen""")
WITHDRAWAL_FORM = LEGAL_TEXT["withdrawal"] + terms("""
    withdrawal form, widerrufsformular, formulaire de retractation, modulo di recesso, modulo recesso,
    formulario de desistimiento, modelformulier voor herroeping, herroepingsformulier""")
WITHDRAWAL_MAIL = terms("""
    withdraw*, cancel your order, widerruf*, retract*, recesso, recedere, desist*, herroep*""")
MAIL_WORDS = terms("email, e mail, mail, courriel, correo, posta elettronica")
WITHDRAWAL_HEADING = LEGAL_TEXT["withdrawal"]
WITHDRAWAL_LINK = LEGAL_TEXT["withdrawal"] + LEGAL_SLUGS["withdrawal"]

# Withdrawal policy - statutory days, number words, day and month units.
STATUTORY_DAYS = 14
DAYS_PER_MONTH = 30
NUMBER_WORDS = {
    14: "fourteen vierzehn quatorze quattordici catorce veertien",
    30: "thirty dreissig trente trenta treinta dertig",
    1: "one ein einen einem un une uno una een",
}
DAY_UNIT = (r"(?:calendar\s+|working\s+|kalender)?"
            r"(?:days?|tage?n?|kalendertage?n?|werktage?n?|jours?|giorni|dias|dagen|kalenderdagen)")
MONTH_UNIT = r"(?:months?|monat(?:e|en)?|mois|mes[ei]?|meses|maand(?:en)?)"

# Environmental claims.
ENVIRONMENTAL = {
    "en": terms("""
        eco, ecofriendly, ecological*, environmentally friendly, environment friendly, good for the planet,
        planet friendly, earth friendly, green, greener, sustainab*, climate neutral, climate positive,
        climate friendly, carbon neutral, carbon negative, carbon free, co2 neutral, net zero, zero emission*,
        biodegradable, compostable, recycl*, plastic free, zero waste"""),
    "de": terms("""
        oko, okologisch*, okostrom, umweltfreundlich*, umweltschonend*, nachhaltig*, klimaneutral*,
        klimapositiv*, klimafreundlich*, co2 neutral*, co2 frei*, biologisch abbaubar*, kompostierbar*,
        recycel*, plastikfrei*, emissionsfrei*"""),
    "fr": terms("""
        ecologique*, eco responsable*, ecoresponsable*, eco concu*, respectueu* de l'environnement,
        respectueu* de la planete, durable*, neutre en carbone, neutre pour le climat, climatiquement neutre*,
        neutralite carbone, bas carbone, biodegradable*, compostable*, recycl*, zero dechet"""),
    "it": terms("""
        ecologic*, sostenibil*, ecosostenibil*, eco sostenibil*, rispettos* dell'ambiente, amic* dell'ambiente,
        a impatto zero, climaticamente neutr*, biodegradabil*, compostabil*, riciclat*, riciclabil*"""),
    "es": terms("""
        ecologic*, sostenible*, sustentable*, respetuos* con el medio ambiente, neutro en carbono,
        neutral en carbono, climaticamente neutr*, biodegradable*, compostable*, reciclad*, reciclable*,
        cero residuos"""),
    "nl": terms("""
        duurzaam*, duurzame, milieuvriendelijk*, klimaatneutra*, co2 neutra*, biologisch afbreekbaar*,
        composteerbaar*, gerecycl*, recyclebaar*, groen, groene"""),
}
NEUTRALITY = terms("""
    carbon neutral, climate neutral, co2 neutra*, net zero, climate positive, carbon negative,
    klimaneutral*, klimapositiv*, neutre en carbone, neutre pour le climat, climatiquement neutre*,
    neutralite carbone, a impatto zero, climaticamente neutr*, neutro en carbono, neutral en carbono,
    carbono neutral*, klimaatneutra*""")
OFFSET = terms("""
    offset*, compensa*, compense*, gecompenseerd, kompensation*, kompensier*, ausgleich*, ausgeglichen,
    carbon credit*, co2 zertifikat*, klimaschutzprojekt*, climate project*, projet* climat*, credits carbone,
    crediti di carbonio, creditos de carbono""")
SELF_LABEL = terms("""
    our eco label, our own eco label, our green label, our sustainability label, our sustainability seal,
    our eco seal, our own label, our in house label,
    unser* oko siegel, unser* oko label, unser* eigene* siegel, unser* nachhaltigkeitssiegel, unser* umweltsiegel,
    unser* gutesiegel,
    notre label eco*, notre propre label, notre label maison, notre label durable,
    il nostro marchio ecologico, il nostro eco label, il nostro marchio di sostenibilita,
    nuestro sello ecologico, nuestra etiqueta ecologica, nuestro sello de sostenibilidad,
    ons eigen keurmerk, ons duurzaamheidskeurmerk, ons eco keurmerk, ons eco label, ons milieukeurmerk""")
CLAIM_SENTENCES = 40
VERDICTS = ["generic_unsubstantiated", "specific_substantiated", "not_environmental"]

# Accessibility statement wording and titles.
CONFORMANCE = terms("""
    wcag, en 301 549, european accessibility act, barrierefreiheitsstarkungsgesetz, bfsg, rgaa,
    fully compliant, partially compliant, not compliant, partially conform*, fully conform*,
    teilweise konform, vollstandig konform, nicht konform,
    partiellement conforme, totalement conforme, non conforme,
    parzialmente conforme, pienamente conforme, parcialmente conforme, totalmente conforme,
    gedeeltelijk conform*, volledig conform*""")
STATEMENT_TITLE = terms("""
    accessibility statement, erklarung zur barrierefreiheit, barrierefreiheitserklarung,
    declaration d'accessibilite, dichiarazione di accessibilita, declaracion de accesibilidad,
    toegankelijkheidsverklaring""")

# Chat and consent vendors by lower-case substrings of a script URL, first vendor wins.
CHAT_VENDORS = {
    "Intercom": ["widget.intercom.io", "js.intercomcdn.com"],
    "Drift": ["js.driftt.com", "js.drift.com"],
    "Crisp": ["client.crisp.chat"],
    "Tidio": ["code.tidio.co", "tidiochat"],
    "Zendesk": ["static.zdassets.com", "ekr.zdassets.com", "zopim.com"],
    "Gorgias": ["gorgias.chat", "gorgias.io"],
    "HubSpot": ["js.usemessages.com", "js.hs-scripts.com"],
    "Freshchat": ["freshchat.com"],
    "LiveChat": ["cdn.livechatinc.com"],
    "Tawk": ["embed.tawk.to"],
    "Shopify Inbox": ["shopifychat", "shopify-chat", "shopify_chat"],
}
CONSENT_VENDORS = {
    "Cookiebot": ["cookiebot.com"],
    "Usercentrics": ["usercentrics.eu", "usercentrics.com"],
    "OneTrust": ["cdn.cookielaw.org", "onetrust.com", "optanon"],
    "Didomi": ["privacy-center.org", "didomi"],
    "iubenda": ["iubenda.com"],
    "CookieYes": ["cookieyes"],
    "Complianz": ["complianz"],
    "Quantcast Choice": ["quantcast.mgr.consensu.org", "cmp.quantcast.com"],
    "TrustArc": ["trustarc.com"],
    "Axeptio": ["axept.io"],
    "Klaro": ["klaro"],
    "Borlabs Cookie": ["borlabs-cookie"],
    "Termly": ["termly.io"],
    "Osano": ["osano.com"],
    "Sourcepoint": ["sourcepoint", "sp-prod.net"],
    "Cookie Script": ["cookie-script.com"],
    "CookieFirst": ["cookiefirst.com"],
    "consentmanager": ["consentmanager.net"],
}

# Wording that tells people they talk to a machine.
AI_DISCLOSURE = terms("""
    chatbot*, chat bot, virtual assistant, ai assistant, ai powered, artificial intelligence, automated assistant,
    virtuelle* assistent*, virtueller assistent*, kunstliche* intelligenz, ki assistent*, ki chat*,
    digitale* assistent*, assistant virtuel, intelligence artificielle, agent conversationnel,
    assistente virtuale, intelligenza artificiale, asistente virtual, inteligencia artificial,
    virtuele assistent, kunstmatige intelligentie""")
AI_ACRONYMS = ["AI", "KI", "IA"]
AUTOMATED = terms("automated, automatisiert*, automatise*, automatizzat*, automatizad*, geautomatiseerd*")
CHAT_CONTEXT = terms("""
    chat*, assistant*, assistent*, assistente*, asistente*, conversation*, conversazion*, conversacion*,
    gesprek*, messag*, nachricht*, replies, answers, antwort*, repond*, rispond*, respond*, beantwort*""")

# Buttons of a consent banner and words that reveal one.
ACCEPT = terms("""
    accept all, accept, accept cookies, allow all, allow cookies, i agree, agree, ok, got it,
    alle akzeptieren, akzeptieren, alle cookies akzeptieren, zustimmen, alle zulassen, einverstanden, annehmen,
    tout accepter, accepter, j'accepte, accepter et fermer, accetta tutti, accetta, accetto,
    aceptar todo, aceptar todas, aceptar, acepto,
    alles accepteren, accepteren, akkoord, alle cookies accepteren""")
REJECT = terms("""
    reject all, reject, decline, decline all, deny, refuse, necessary only, only necessary,
    necessary cookies only, essential only, only essential,
    alle ablehnen, ablehnen, nur notwendige*, nur essenzielle*, nur erforderliche*, verweigern,
    tout refuser, refuser, refuser tout, continuer sans accepter,
    rifiuta tutti, rifiuta, solo necessari, continua senza accettare,
    rechazar todo, rechazar todas, rechazar, solo necesarias,
    alles weigeren, weigeren, afwijzen, alles afwijzen, alleen noodzakelijke""")
COOKIE_WORDS = terms("""
    cookie*, tracking, consent, einwilligung, consentement, consenso, consentimiento, toestemming""")

# Address lines. Street families DE/NL, FR, IT/ES/PT, EN; postcodes general, NL, AT/BE/DK/LU, IE.
STREETS = [
    r"(?iu)[\p{L}-]*(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|gracht|straat|laan|plein|kade|singel"
    r"|steeg|dijk)\s*\d+",
    r"(?iu)\d+\s*(?:bis|ter)?,?\s+(?:rue|avenue|av\.|boulevard|bd|chemin|place|quai|impasse|allée|route|cours)"
    r"(?!\p{L})",
    r"(?iu)(?<!\p{L})(?:via|viale|piazza|piazzale|corso|largo|vicolo|calle|avenida|avda\.|plaza|paseo|carrer|camino"
    r"|rua)\s+[\p{L}'. ]{2,40}?,?\s*\d+",
    r"(?iu)\d+[a-z]?\s+[\p{L}'. ]{2,40}?\s(?:street|st\.|road|rd\.|lane|avenue|ave\.|way|square|place|drive|quay)"
    r"(?!\p{L})",
]
POSTCODES = [
    r"(?<!\d)\d{5}\s+\p{Lu}",
    r"(?<!\d)\d{4}\s?[A-Z]{2}\s+\p{Lu}",
    r"(?<!\d)\d{4}\s+\p{Lu}\p{Ll}+",
    r"(?<![A-Z0-9])[AC-FHKNPRTV-Y]\d{2}\s?[0-9AC-FHKNPRTV-Y]{4}(?![A-Z0-9])",
]
# EU VAT numbers by prefix, tested after spaces, dots and hyphens are removed.
VAT_NUMBERS = {
    "ATU": r"\d{8}(?!\d)", "BE": r"[01]\d{9}(?!\d)", "BG": r"\d{9,10}(?!\d)", "CY": r"\d{8}[A-Z]",
    "CZ": r"\d{8,10}(?!\d)", "DE": r"\d{9}(?!\d)", "DK": r"\d{8}(?!\d)", "EE": r"\d{9}(?!\d)",
    "EL": r"\d{9}(?!\d)", "ES": r"[A-Z0-9]\d{7}[A-Z0-9]", "FI": r"\d{8}(?!\d)",
    "FR": r"[0-9A-HJ-NP-Z]{2}\d{9}(?!\d)", "HR": r"\d{11}(?!\d)", "HU": r"\d{8}(?!\d)",
    "IE": r"\d[0-9A-Z+*]\d{5}[A-Z]{1,2}", "IT": r"\d{11}(?!\d)", "LT": r"(?:\d{12}|\d{9})(?!\d)",
    "LU": r"\d{8}(?!\d)", "LV": r"\d{11}(?!\d)", "MT": r"\d{8}(?!\d)", "NL": r"\d{9}B\d{2}",
    "PL": r"\d{10}(?!\d)", "PT": r"\d{9}(?!\d)", "RO": r"\d{2,10}(?!\d)", "SE": r"\d{12}(?!\d)",
    "SI": r"\d{8}(?!\d)", "SK": r"\d{10}(?!\d)", "XI": r"\d{9}(?!\d)",
}
REGISTER_WORDS = terms("""
    hrb, hra, handelsregister, registergericht, amtsgericht, firmenbuch*, steuernummer, ust idnr, ust id,
    umsatzsteuer*, vat, vat number, vat id, company number, company registration*, registration number,
    registered in, companies house, trade register, commercial register, chamber of commerce, cro,
    rcs, siren, siret, registre du commerce*, tva, numero d'entreprise,
    rea, registro delle imprese, partita iva, p iva, codice fiscale, registro mercantil, cif, nif,
    kvk, kamer van koophandel, kbo, ondernemingsnummer, btw*""")
LONG_NUMBER = r"\d(?:[\s./-]?\d){4,}"

# E-mail addresses, plain and spelled out.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
EMAIL_SPELLED = (r"(?i)[A-Za-z0-9._%+-]+\s*[\[(]\s*at\s*[\])]\s*[A-Za-z0-9-]+"
                 r"(?:\s*(?:\.|[\[(]\s*dot\s*[\])])\s*[A-Za-z0-9-]+)+")

# EU targeting.
EUR_PRICE = r"€\s?\d|\d[\d.,]*\s?€|\bEUR\s?\d|\d[\d.,]*\s?EUR\b"
CURRENCY_KEYS = ["og:price:currency", "product:price:currency"]
SHIPPING = terms("""
    ship*, deliver*, versand*, versend*, liefer*, livraison*, livrons, expedi*, spedizion*, spediamo,
    consegn*, envio*, enviamos, entrega*, verzend*, levering*, leveren, bezorg*""")
EUROPE = terms("""
    eu, e u, europe, european union, europa, europaweit*, eu weit*, ue, union europeenne, unione europea,
    union europea, europese unie""")
EU_LANGUAGES = "bg cs da de el es et fi fr ga hr hu it lt lv mt nl pl pt ro sk sl sv".split()
EU_DOMAINS = "at be bg cy cz de dk ee es eu fi fr gr hr hu ie it lt lu lv mt nl pl pt ro se si sk".split()

# Language guessed from a country domain.
DOMAIN_LANGUAGE = {
    "de": "de", "at": "de", "fr": "fr", "it": "it", "es": "es", "nl": "nl", "be": "nl", "lu": "fr",
    "pt": "pt", "pl": "pl", "se": "sv", "dk": "da", "fi": "fi", "cz": "cs", "sk": "sk", "hu": "hu",
    "ro": "ro", "bg": "bg", "hr": "hr", "si": "sl", "gr": "el", "ee": "et", "lv": "lv", "lt": "lt",
    "ie": "en", "mt": "en", "cy": "el",
}
