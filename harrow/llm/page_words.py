"""The wording of page furniture, notices and filler, for labelling and judging lines."""

from __future__ import annotations

import re

#: Entries of site menus (English, German, French, Spanish), lower case.
MENU = frozenset(
    """home|about|about us|services|our work|contact|contact us|careers|jobs|imprint|team|press|news|blog|faq|partners|gallery|login|log in|sign in|basket|search|products|my account|sitemap|downloads|help|support|shop|cart|privacy|terms
startseite|über uns|leistungen|kontakt|karriere|impressum|presse|aktuelles|anmelden|warenkorb|suche|produkte|datenschutz|agb|partner|referenzen
accueil|à propos|carrières|connexion|panier|recherche|produits|actualités|plan du site|mentions légales|équipe
inicio|quiénes somos|servicios|contacto|empleo|acceder|carrito|buscar|productos|noticias|mapa web|aviso legal|privacidad|equipo""".replace("\n", "|").split("|")
)

#: Lines that belong to the furniture of a page.
FURNITURE = re.compile(
    r"""^(?:
    .*\b(?:which\ trackers|tracking\ categories)\b.* | .*\bcookies?\b.*\b(?:accept|agree|reject|akzeptieren|aceptar|accepter|ok)\b.* |
    .*\b(?:use|our\ use\ of|verwenden|usamos|utilisons\ des)\ cookies\b.* | .*\bcookie(?:s|-|\ )?(?:settings|preferences|policy|banner|einstellungen)\b.* |
    .*\bpartners\ would\ like\ to\ measure\b.* | .*\bstores?\ small\ files\ on\ your\ device\b.* | strictly\ necessary\ storage\b.* | we\ value\ your\ privacy\b.* | your\ privacy\ matters\b.* |
    functional\ \[.* | consent\ choices | no\ thanks,\ only.* | .{0,4}ok,\ got\ it | .*by\ continuing\ to\ browse.* | puede\ retirar\ su\ consentimiento.* | gérer\ vos\ préférences.* | .*einwilligung.*widerrufen.* | .*datenschutz.*einstellungen.* | languages?:.* | sprachen?:.* | langues?\ ?:.* | idiomas?:.* |
    some\ features\ need\ javascript.* |
    related\ articles | quick\ links | back\ to\ (?:top|overview).* | skip\ to\ content | print\ this\ page | (?:.*:\ )?share\ this\ page | follow\ us | (?:.*:\ )?subscribe | (?:.*:\ )?advertisement | most\ read | latest\ news |
    you\ may\ also\ like | chat\ with\ us | leave\ a\ comment | enter\ your\ email.* | sign\ up\ for.* | get\ our\ guide.* | your\ basket\ is.* | request\ a\ call.* | download\ the\ brochure.* | .*people\ are\ viewing.* |
    filter\ by:.* | tags:.* | posted\ in.* | read\ next.* | .+:\ read\ next | case\ study:.*\(read\ more\) | recently\ viewed.* | rate\ this.* | five\ things.* | more\ on\ .*» | jobs\ at\ .* | compare\ up\ to.* |
    text\ size.* | upcoming:.* | opening\ hours:.* | «\ previous.* | sponsored:.* |
    .*(?:»|(?:…|\.\.\.)(?:\ *read\ more)?) |
    complaints\ procedure.* | payment\ by\ card.* | contact:\ switchboard.* | version\ [\d.]+ | last\ updated.* | prices\ exclude\ vat.* | .*is\ a\ trading\ name;\ registered.* | copyright\ .* | ©.* | modern\ slavery\ statement |
    terms\ of\ use.* | made\ with\ care\ in.* | member\ of\ the\ .* | images:\ .* | registered\ office.* | site\ by\ .* | certified\ under\ scheme.* | .*does\ not\ collect\ personal\ data.* | the\ information\ on\ this\ site\ is\ provided.* |
    haut\ de\ page | volver\ (?:arriba|al\ listado) | nach\ oben | zurück\ zur\ übersicht | retour\ à\ la\ liste | suivez-nous | síganos | folgen\ sie\ uns | partager\ cette\ page | compartir\ esta\ página | seite\ teilen |
    suscribirse.* | s[’']abonner.* | newsletter\ abonnieren | también\ le\ puede.* | das\ könnte\ sie.* | à\ lire\ aussi | öffnungszeiten.* | für\ inhalte\ verlinkter.* | (?:impressum|mentions\ légales|aviso\ legal)\ \|.* |
    horario:.* | horaires.* | heures\ d.* | nous\ ne\ sommes\ pas\ responsables.* | l[’']éditeur\ n.* | no\ nos\ hacemos\ responsables.*
    )$""",
    re.I | re.X,
)

#: Text that stands where a page's content should be because there is none to show.
NOTICE = re.compile(
    r"""\b(?:
    not\ found | page\ introuvable | n[’']existe\ plus | nicht\ gefunden | existiert\ (?:leider\ )?nicht | no\ hemos\ encontrado | no\ existe |
    (?:can't|cannot|can[’]t|couldn[’']t|could\ not|unable\ to|won[’']t)\ (?:find|locate|load|be\ served|be\ found|work|complete|display|show|open|process|connect) | nobody\ here\ knows | there\ is\ nothing\ at | gone\ missing | has\ gone | does\ not\ lead |
    moved\ or\ been\ renamed | (?:was|been)\ (?:removed|deleted|suspended|disabled|blocked) | content\ was\ removed | no\ longer\ (?:available|exists) |
    (?:javascript|scripts?|scripting|js)\b.{0,40}\b(?:enable|enabled|disabled|required|reload|allowed|on|needed|turn|activate) | (?:enable|activate|activer|aktivieren|active|needs?|requires?|relies\ on|depends\ on|need\ to|without|allow|turn\ on|turn)\b.{0,40}\b(?:javascript|scripts?|scripting|js) |
    does\ not\ run\ scripts | nothing\ can\ be\ shown | scripts\ must\ be |
    forbidden | access\ (?:to\ this\ (?:page|site|resource)\ )?(?:is\ )?denied | permission\ to\ (?:view|access) | refused\ by | (?:are|is|were|was|been)\ (?:temporarily\ )?(?:blocked|banned|refused|denied) | unauthori[sz]ed | valid\ sign-in | sign\ in\ (?:again|to\ continue|required) | please\ (?:sign|log)\ in | log\ in\ to\ continue | session\ (?:has\ )?expired |
    verify\ you\ are | are\ you\ (?:a\ )?human | captcha | complete\ the\ puzzle | checking\ your\ browser | takes\ up\ to\ .{1,10}seconds | automated\ requests | unusual\ traffic | ad\ blocker |
    too\ many\ requests | slow\ down\ and | over\ its\ limit | rate\ limit | try\ (?:again|later|the\ search) | (?:bad\ gateway|gateway\ time-?out|internal\ server|server\ error|internal\ error) | upstream | service\ (?:temporarily\ )?unavailable | temporarily\ (?:unavailable|offline) |
    something\ went\ wrong | having\ a\ moment | hit\ a\ snag | is\ not\ answering | did\ not\ answer | could\ not\ complete | engineers\ have\ been | be\ right\ back | back\ (?:shortly|soon|online) | (?:maintenance\ (?:in\ progress|mode|window|page)|(?:under|down\ for|scheduled|undergoing)\ maintenance) | planned\ works | under\ construction | coming\ soon |
    error\ establishing | fatal\ error | warning:\ | traceback | uncaught | exception | stack\ trace | keyerror | typeerror | connection\ is\ not\ private | err_[a-z_]+ | certificate | account\ (?:has\ been\ )?suspended | hosting\ provider |
    domain\ is\ (?:parked|for\ sale) | parked | not\ yet\ published | related\ searches | index\ of\ / | parent\ directory | apache\ (?:server|http) | it\ works! | welcome\ to\ nginx |
    start\ page | (?:vuelva|volver)\ al?\ inicio | retour(?:nez)?\ à\ l[’']accueil | zur(?:ück\ zur)?\ startseite | contact\ the\ site\ owner | contact\ your | (?:cargando|loading|chargement|laden)\b | requested\ (?:url|page|address) | gewünschte\ seite | cette\ adresse | dieser\ (?:seite|dienst) | mistake
    )""",
    re.I | re.X,
)
_NOTICE_LINE = re.compile(r"^(?:\d{3}(?:\s+\w+)?|gone|error|oops!?|nginx|(?:code|event\ id|incident|ref(?:erence)?|ray|request\ id)\b.{0,30}|file\ \".*|.*\ line\ \d+.*|.*\ at\ \S+\ port\ \d+)\.?$", re.I | re.X)

#: Text that only holds a place.
FILLER = re.compile(
    r"""lorem\ ipsum | \b(?:dolor\ sit|consectetur|adipiscing|eiusmod|incididunt)\b | \b(\w+)(?:\ \1){3,}\b | ^(?:(\w+)\ (\w+)(?:\ (\w+))?)(?:\ \2\ \3(?:\ \4)?)+ | (?:dummy|sample|placeholder|filler)\ (?:copy|text|page|paragraph|content) | placeholder\) |
    blindtext | platzhaltertext | texte\ de\ remplacement | texto\ de\ (?:ejemplo|relleno) | (?:double-|doppel)?(?:click|klicken|haga\ clic|cliquez)\b.{0,40}\b(?:edit|change|editar|modifier|bearbeiten) | drag\ it\ anywhere | replace\ this\ text | goes\ in\ this\ box | goes\ here | your\ story\ starts\ here | (?:add|write)\ (?:a\ few\ lines|your\ (?:text|content)) |
    just\ another\ .{0,20}\ site | hello\ world | ^(?:asdf|qwert|jkl)|steht\ später""",
    re.I | re.X,
)
_LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud".split())

#: Headings that say nothing about what a page holds.
NEUTRAL = re.compile(r"^(?:about|about us|services|our services|welcome|our story|home|news|untitled|contact|leistungen|willkommen|über uns|bienvenue|à propos|bienvenidos?|inicio|servicios|page|site)[.!]?$", re.I)

#: The single words of menu entries.
MENU_WORDS = frozenset(w for entry in MENU for w in entry.split())

_MENU_SPLIT = re.compile(r"\s*[/|·>»•–-]\s+|\s{2,}|\s[/|·>»•]\s*")
_COUNT = re.compile(r"\s*\(\d+\)$")


def is_menu(text: str, raw: str = "") -> bool:
    """A line of menu entries or a path through the site."""
    parts = [p for p in _MENU_SPLIT.split(raw or text) if p.strip()]
    if len(parts) >= 2:
        known = sum(_COUNT.sub("", p.strip().lower()) in MENU for p in parts)
        return known >= len(parts) - 1 and known >= 1
    words = re.findall(r"[^\W\d_]+", text.lower())
    return bool(words) and (_COUNT.sub("", text.strip().lower()) in MENU or (len(words) > 2 and all(w in MENU_WORDS for w in words)))


def is_notice(text: str) -> bool:
    return bool(NOTICE.search(text) or _NOTICE_LINE.match(text))


def is_filler(text: str) -> bool:
    if FILLER.search(text):
        return True
    words = re.findall(r"[a-z]+", text.lower())
    return len(words) > 3 and sum(w in _LATIN for w in words) >= 0.8 * len(words)
