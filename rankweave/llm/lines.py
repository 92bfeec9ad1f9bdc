"""What a single line of page text looks like: menu, notice, advert, footer, heading, list, prose.

The vocabulary is general web vocabulary in English, German, Spanish and French. ``furniture_score``
is the log-odds, as a hand-set linear model, that a line taken alone is page furniture.
"""

from __future__ import annotations

import re
from functools import lru_cache

from rankweave.llm.screen import Screen

# Labels of site menus.
MENU = """
home|start|blog|news|newsroom|shop|store|forum|forums|community|contact|contact us|about|about us|careers|jobs|press|partners|company|pricing|plans|prices
|reviews|review|tests|guides|guide|deals|offers|compare|comparisons|newsletter|log in|login|sign in|sign up|register|join|account|my account|help|help centre
|help center|support|faq|search|menu|cart|basket|wishlist|privacy|privacy policy|terms|terms of use|terms of service|imprint|legal|legal notice|sitemap|cookie settings|cookies
|accessibility|report a problem|advertise|advertise with us|settings|categories|topics|products|features|resources|download|downloads|events|podcast|video|videos
|photos|feed|mail|copy link|print|email|language|english|deutsch|español|français|subscribe|share
|startseite|ratgeber|hilfe|kontakt|über uns|ueber uns|anmelden|abmelden|registrieren|angebote|preise|vergleich|vergleiche|karriere|presse|impressum|datenschutz|agb|nutzungsbedingungen
|suche|warenkorb|merkzettel|konto|mein konto|drucken|teilen|link kopieren|e-mail|werbung|inhaltsverzeichnis|übersicht|mediadaten
|inicio|portada|guías|guias|ayuda|contacto|quiénes somos|quienes somos|sobre nosotros|entrar|iniciar sesión|registrarse|regístrese|ofertas|precios|análisis|analisis|comparar|comparativas|boletín
|empleo|prensa|publicidad|aviso legal|privacidad|condiciones|mapa del sitio|tienda|foro|buscar|cesta|cuenta|imprimir|correo|copiar enlace|anunciantes
|accueil|aide|à propos|a propos|qui sommes-nous|connexion|inscription|s'inscrire|offres|tarifs|prix|comparer|comparatifs|avis|lettre|emploi|emplois|presse|annonceurs|mentions légales
|confidentialité|cgu|plan du site|boutique|rechercher|panier|compte|imprimer|copier le lien|conditions
"""
LABELS = frozenset(x.strip() for x in MENU.replace("\n", "").split("|") if x.strip())
_SEPARATED = re.compile(r"\s*(?:[|·•›»>/–]|\s-\s|\s{2,}|\t)\s*")
# Phrases of page furniture, each group with its weight.
PHRASES = (
    (4.0, r"\bcookies?\b.{0,80}\b(?:accept|agree|ok|allow|refuse|reject|decline|settings|save|set|use|notice|manage|necessary|necesarias|aceptar|rechazar|annehmen|ablehnen|refuser|accepter|autoriser|zustimmen|einstellungen|paramètres|verwenden|utilizamos|utilisons|déposons|usamos)\b"),
    (4.0, r"\b(?:we use|wir (?:verwenden|nutzen)|utilizamos|usamos|nous (?:utilisons|déposons)|uses?|sets?) .{0,30}\b(?:cookies|small files)\b|cookies help us|choose which cookies|store small files|sets small files|keep data on your device|remembers your visits|your choice about data|your privacy matters|word about privacy|your consent\b|track visits|data on your device|store (?:and|or) access"),
    (4.0, r"ihre wahl zum datenschutz|speichern daten auf ihrem|auf ihrem gerät|kleine dateien|ihre privatsphäre|guardan? (?:datos|pequeños archivos)|en su dispositivo|tratamos datos|su privacidad|sus? elecci[oó]n sobre|votre choix|vie privée|vos données|traitons des données|petits fichiers|sur votre appareil|datenschutz.{0,40}(?:ablehnen|zustimmen|notwendige|einstellungen|annehmen)"),
    (2.5, r"\b(?:accept all|reject all|allow (?:all|everything|refuse)|necessary only|only necessary|agree and close|manage (?:settings|options)|save choices|i understand|yes, i agree|ok, got it|got it|alle annehmen|nur notwendige|alles ablehnen|aceptar todo|rechazar todo|solo (?:las )?necesarias|einverstanden|de acuerdo|d'accord|tout accepter|tout refuser|continuer sans accepter)\b"),
    (4.5, r"^(?:©|\(c\)|copyright\b)|\ball rights reserved\b|alle rechte vorbehalten|todos los derechos reservados|tous droits réservés|all content protected|alle inhalte geschützt|prohibida la copia|reproduction interdite|trading name of|^published by \w+|prices may change, see terms|made with care in|^a project from\b|^ein projekt (?:von|aus)\b|^un projet (?:de|d')|^un proyecto de\b|hecho con cariño|mit liebe gemacht|fait avec soin|veröffentlicht von|publicado por|publié par|eine marke (?:von|der)|es una marca de|est une marque de"),
    (4.0, r"\b(?:terms|imprint|privacy|impressum|agb|aviso legal|privacidad|mentions légales|confidentialité|publicidad|annonceurs|mediadaten)\b\s*[|/·•]|[|/·•]\s*(?:terms|imprint|privacy|jobs|impressum|agb|datenschutz|contact|aviso legal|privacidad|empleo|emploi|advertise with us)\b"),
    (4.0, r"^[\w .,&'-]{2,40}\bversion \d[\d.]*$|^[\w .&'-]{2,40}(?:,| [·|–-]) (?:\d+ (?:rue|avenue|place|calle)|\w+ (?:row|street|road|lane)|(?:calle|avenida|plaza) \w+)\b.{0,50}$|\b(?:media|éditions|editions|ediciones|verlag|medien),? \d+ \w+|\b\d+ (?:rue (?:du|de|des)|avenue|calle)\b.{0,40}, [\w ]+$|\w+(?:straße|strasse|weg|gasse) \d+, [\w ]+$|\b(?:calle|avenida) [\w ]+ \d+, [\w ]+$"),
    (1.5, r"\b(?:version \d|imprint|sitemap|impressum|aviso legal|mentions légales|advertise with us)\b"),
    (4.0, r"^(?:skip to (?:main )?content|zum inhalt(?: springen)?|saltar al contenido|ir al contenido|aller au contenu|back to top|nach oben|zurück nach oben|volver arriba|haut de page|retour en haut|jump to\b.*)$"),
    (4.0, r"^(?:advertisements?|sponsored(?: content)?|anzeige|werbung|publicidad|anuncio|patrocinado|publicité|annonce|sponsorisé|gesponsert|ad|promoted)(?:$|[.:!]|\s+(?:-|·|\||enter|sign|in our|and save|report|print|now|click|escriba|votre|e-mail|in der|en la|en nuestra|dans|jetzt|drucken|imprimir|imprimer)\b)"),
    (4.0, r"newsletter.{0,60}(?:subscribe|enter|miss|abonnieren|sign|join|suscr|abonn|escriba|votre|bolet)|\b(?:subscribe to our|sign me up|join our list|join free|enter your e-?mail|your e-?mail address|create a free account|get the weekly letter|get the app|new deals every|weekly letter|no spam|leave at any time|never miss a deal)\b|e-mail eingeben|jederzeit kündbar|suscr[ií]base|escriba su correo|sin compromiso|inscrivez-vous|votre adresse|la lettre du|la carta del|el boletín|der (?:wochen|freitags)brief|e-mail eintragen|jetzt anmelden\b|abonnez-vous|recevez (?:nos|la)|reciba (?:nuestras|la)|kein angebot verpassen|kostenlos(?:es)? konto|cuenta gratis|cree una cuenta|compte gratuit|créez un compte|die app (?:für|laden)|descargue la app|téléchargez l'app|ofertas cada viernes|angebote (?:jeden|am) freitag|offres (?:chaque|du) vendredi|unverbindlich|sans engagement|sin spam|ohne spam"),
    (4.0, r"^(?:share(?: this| with)|follow us|follow \w+|compartir|compartan?|síganos|siga a|teilen|folgen sie|partager|partagez|suivez)\b|copy link|copiar enlace|link kopieren|copier le lien|print \| mail|share this article"),
    (4.0, r"^(?:was this page helpful|rate this page|want more tips|listen to this page|sign in to save|loved by \d|this page helped|diese seite (?:bewerten|anhören)|war diese seite|bewerten sie|seite bewerten|valore esta página|le resultó útil|fue útil|escuche esta|notez cette page|cette page vous|écoutez cette|show more|load more|mehr (?:anzeigen|laden)|mostrar más|ver más|cargar más|afficher plus|voir plus|charger plus)\b"),
    (3.5, r"^(?:\d+ (?:comments?|comentarios|commentaires|kommentare)\b|(?:comments?|comentarios|commentaires|kommentare) \(\d+\))"),
    (1.5, r"\b(?:leave a reply|print|report|drucken|imprimir|imprimer)$"),
)
_PHRASES = tuple((w, re.compile(p, re.I)) for w, p in PHRASES)
_SCREEN = Screen([p for _, p in _PHRASES])
# Headers of lists of other pages.
RELATED = re.compile(
    r"^(?:you (?:may|might) also like|related(?: (?:articles|posts|reading|guides|pages))?|popular(?: (?:this week|now|articles|posts))?|read next|up next|more from\b.{0,40}|more (?:articles|stories)|most read|recommended(?: for you)?|trending(?: now)?|others also read|see also"
    r"|ähnliche (?:artikel|beiträge|themen)|meistgelesen|das könnte (?:sie|dich|ihnen) auch.{0,20}|mehr (?:von|aus|zum thema)\b.{0,40}|weiterlesen|auch interessant|lesen sie (?:auch|weiter).{0,20}|beliebt(?:e artikel)?.{0,15}|weitere artikel"
    r"|artículos relacionados|lo más leído|también (?:le|te) (?:puede|podría) (?:interesar|gustar)|más de\b.{0,40}|siga leyendo|seguir leyendo|lea también|relacionados|populares?(?: esta semana)?"
    r"|articles (?:liés|similaires|populaires|connexes)|à lire (?:aussi|ensuite)|les plus lus|plus de\b.{0,40}|vous aimerez aussi|lire aussi|à découvrir|populaires?)[:.]?$",
    re.I,
)
CRUMB = re.compile(r"^(?:home|start|startseite|inicio|portada|accueil)\s*[>»›/]\s*\S", re.I)
STOP = frozenset(
    "the a an and or of to in on for with is are was were be it its this that we you they our your if when while but not as at by from after before than then there so how what who which will can should may has have had do does did no only yet still"
    " der die das ein eine einen und oder von zu im in auf für mit ist sind war wir sie er es man nicht als bei nach vor wenn aber auch nur noch wie was wer den dem des sich bleibt wer sollte"
    " el la los las un una unos y o de del en por para con es son fue que se lo su sus no como más pero si cuando al este esta aunque cada le"
    " le les un une des et ou du de en pour avec est sont ce cette que qui se sa son ses ne pas plus mais si quand au aux dans sur il elle nous vous tout".split()
)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LABEL_WORDS = frozenset(tuple(WORD.findall(x)) for x in LABELS)
_LABEL_SIZES: dict[str, tuple[int, ...]] = {w: tuple(sorted({len(x) for x in _LABEL_WORDS if x[0] == w}, reverse=True)) for w in {x[0] for x in _LABEL_WORDS}}
_END = re.compile(r"[.!?。！？…][\"”’)\]]*$")


@lru_cache(1 << 16)
def menu_share(line: str) -> float:
    """Share of a line's letters that are menu labels."""
    words = WORD.findall(line.lower())
    letters, covered, found, i = sum(map(len, words)), 0, 0, 0
    while i < len(words):
        n = next((n for n in _LABEL_SIZES.get(words[i], ()) if tuple(words[i : i + n]) in _LABEL_WORDS), 0)
        covered += sum(map(len, words[i : i + n]))
        found += n > 0
        i += n or 1
    share = covered / letters if letters else 0.0
    return share if found > 2 or share > 0.97 else 0.0  # two labels in a phrase are no menu


_STOPPED = re.compile(r"[.!?…](?:[\"”’)]|\s|$)")


@lru_cache(1 << 16)
def is_prose(line: str) -> bool:
    """A line with at least one full sentence of function words."""
    if not _STOPPED.search(line):
        return False
    words = WORD.findall(line.lower())
    return len(words) >= 5 and sum(w in STOP for w in words) >= max(2, len(words) // 8)


_SENTENCES = re.compile(r"(?<=[.!?…])\s+")
TOLD = 0.6  # share of sentences without furniture phrases up to which a line of sentences can be furniture


def _told_share(line: str) -> float:
    """Share of a line's characters in full sentences that hold no strong phrase of furniture."""
    told = 0
    for x in _SENTENCES.split(line):
        words = WORD.findall(x.lower())
        if len(words) >= 5 and sum(w in STOP for w in words) >= 2:
            may = _SCREEN.mask(x.lower())
            if not any(w >= 3 and may >> i & 1 and p.search(x) for i, (w, p) in enumerate(_PHRASES)):
                told += len(x)
    return told / len(line)


ITEM = re.compile(r"(?:[-*•#]\s*\S|\d{1,3}[.):]\s|#\d)|[^:|]{2,40}: \S|.*\t|[^|]+ \| [^|]+ \| |[^,]+, [\d.,]+, |.+ - [\d.,]+ - ")  # of a list or a table


@lru_cache(1 << 16)
def furniture_score(line: str) -> float:
    """Log-odds that a stripped, non-empty line taken alone is furniture."""
    s, prose = -1.0, None
    low = line.lower()
    may = _SCREEN.mask(low)
    hits = sorted((w for i, (w, p) in enumerate(_PHRASES) if may >> i & 1 and p.search(line)), reverse=True) if may else []
    if len(hits) == 1 and may & 1 and line.endswith(".") and _PHRASES[0][1].search(line) and is_prose(line):
        hits = []  # a notice ends with what can be pressed; this sentence tells of cookies
    if CRUMB.match(line):
        hits.insert(0, 4.0)
    if RELATED.match(line):
        hits.insert(0, 4.0)
    parts = [p for p in _SEPARATED.split(low) if p]
    labels = sum(p in LABELS for p in parts)
    if len(parts) >= 2 and labels >= 2 and labels >= 0.6 * len(parts):
        hits.append(5.0)
    elif low.rstrip(":") in LABELS:
        s = 0.9
    elif not (prose := is_prose(line)) and menu_share(line) >= 0.75:
        hits.append(4.0)
    if hits:
        s = hits[0] + sum(hits[1:]) / 2
    if is_prose(line) if prose is None else prose:
        s = -4.0 if not hits or hits[0] < 3 or _told_share(line) > TOLD else s
    elif not hits and ITEM.match(line):
        s = min(s, -2.6)
    elif s == -1.0 and title_like(line):
        s = -3.0 if len(WORD.findall(line)) > 3 else -2.0
    elif len(WORD.findall(line)) > 30:
        s -= 2.0
    return max(-5.0, min(6.0, s))


MARKED = re.compile(r"(?:[-*•#]\s*\S|\d{1,3}[.):]\s)")  # an item of a list
_ROW = re.compile(r"\t|\s[|·]\s|\s-\s.*\s-\s|^[^,]+, [\d.,]+, ")  # a row of a table


def title_like(line: str) -> bool:
    """A short line that could be the title of another page."""
    return 2 <= len(WORD.findall(line)) <= 16 and not _ROW.search(line) and not _END.sub("", line) == line.rstrip(".") + "." and not line.endswith((".", "!", ":", ";")) and len(line) <= 130


# Stems of dummy Latin.
LATIN = re.compile(r"^(?:lorem|ipsum|dolor|dolar|sit|amet|consect|adipis|elit|velit|maur|integ|donec|nulla|sodal|quam|fusc|vestib|tincid|luct|eges|vari|praes|porr|port|amen|sed|eiusm|tempor|incid|labor|magna|aliqu|enim|minim|veniam|quis|nostr|exerc|ullam|nisi|commod|cons|duis|aute|irure|repreh|volup|esse|cill|fugia|paria|except|sint|occae|cupid|proid|culpa|offic|deser|mollit|anim|est|laborum|viva|pell|mole|curab|phas|susp|nunc|ante|eros|orci|eget|ut|et|in|ac|non|nec)")


def is_latin(line: str) -> bool:
    """A line of dummy Latin."""
    words = [w.lower() for w in WORD.findall(line)]
    return len(words) >= 4 and sum(bool(LATIN.match(w)) for w in words) >= 0.7 * len(words) and any(w in ("lorem", "ipsum") or len(w) > 4 for w in words)
