"""Word lists and patterns of link, text and page classification (Java and RE2 syntax)."""

SOFT_UTILITY = """
for-you join member members membership newsletter newsletters
plans plus premium pricing recommended
""".split()

CONTENT = """
article articles blog blogs changelog changelogs insight insights
launch launches news post posts release releases story stories update updates
artikel beitrag beitraege nachrichten neuigkeiten aktuelles
articulo articulos noticia noticias entrada entradas publicacion publicaciones
actualite actualites nouvelle nouvelles teaser teasers card cards
""".split()

TAXONOMY = """
category categories tag tags topic topics
kategorie kategorien schlagwort schlagworte thema themen
categoria categorias etiqueta etiquetas tema temas
categorie etiquette etiquettes sujet sujets theme themes
""".split()

VANITY = """
join membership plus premium pricing plans subscribe signup
abonnieren abo suscribirse boletin s-abonner saboner
""".split()

CHROME = """
about account archive archives author authors comment comments contact feedback
help login logout notification notifications preference preferences profile register
search settings share signup subscribe feed feeds comment-feed comments-feed privacy
terms cookie cookies user users autor autoren archiv ueber-uns ueber ueberuns profil
kontakt impressum suche hilfe anmelden registrieren konto registrierung anmeldung
abonnieren abo datenschutz nutzungsbedingungen agb autores archivos sobre-nosotros
sobre quienes-somos buscar busqueda ayuda entrar ingresar registrarse registro cuenta
suscribirse boletin privacidad condiciones auteur auteurs a-propos apropos recherche
rechercher aide connexion s-inscrire sinscrire inscription compte s-abonner saboner
lettre-information confidentialite mentions-legales cgu menu sidebar widget social
modal popup banner promo ad ads related recommendation recommendations pagination pager
dating jobs job career careers deals deal shopping shop trading broker versicherung
tierversicherung insurance vergleich comparison partnerboerse singleboerse krypto crypto
casinos casino kreditkarten kreditkarte kredit echtgeld vpn games kaufberater leasing
""".split()

DEEP_POST_CONTEXT = "press newsroom presse pressemitteilungen prensa".split()

YEARISH = r"^[0-9]{4,}[A-Za-z0-9_-]*$"
POST_SLUG = r"(?i)^[a-z0-9]+(-[a-z0-9]+){2,}$"
HOST_SHAPED = r"(?i)^(www\.)?([A-Za-z0-9_-]+\.)+[a-z]{2,24}$"
FILE_EXTENSION = r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|css|js|mjs|html?|xml|json|mp4|webm|zip|gz)$"

UTILITY_PREFIX_TEXT = (
    r"(?i)^\s*(view\s+all|see\s+all|all\s+news|subscribe|newsletter|comment\s+feed|comments\s+feed|join|premium|plus|"
    r"alle\s+anzeigen|alle\s+news|abonnieren|newsletter|kommentar\s+feed|mitmachen|"
    r"ver\s+todos|ver\s+todo|todas\s+las\s+noticias|suscribirse|bolet(i|í)n|comentarios\s+feed|unirse|"
    r"voir\s+tout|voir\s+tous|toutes\s+les\s+nouvelles|s['’]abonner|flux\s+de\s+commentaires|rejoindre)\b"
)
UTILITY_TEXT = (
    r"(?i)^\s*(about|contact|comments?|join|log\s+in|login|member(ship)?|"
    r"plus|premium|pricing|recommended(\s+for\s+you)?|"
    r"see\s+all|share|sign\s+up|signup|subscribe|view\s+all|"
    r"(ue|ü)ber(\s+uns)?|kontakt|kommentare?|mitmachen|anmelden|login|"
    r"mitglied(schaft)?|empfohlen(\s+f(ue|ü)r\s+dich)?|alle\s+anzeigen|"
    r"teilen|registrieren|abonnieren|newsletter|"
    r"sobre(\s+nosotros)?|contacto|comentarios?|unirse|iniciar\s+sesion|"
    r"login|miembro|membres(i|í)a|recomendado(\s+para\s+ti)?|ver\s+todo|"
    r"compartir|registrarse|suscribirse|bolet(i|í)n|"
    r"(a|à)\s+propos|(a|à)propos|contact|commentaires?|rejoindre|"
    r"se\s+connecter|login|membre|abonnement|recommand(e|é)(\s+pour\s+vous)?|"
    r"voir\s+tout|partager|s['’]inscrire|s['’]abonner|newsletter)\b"
)
RECOMMENDED_TEXT = (
    r"(?i)^\s*(recommended(\s+for\s+you)?|empfohlen(\s+f(ue|ü)r\s+dich)?|"
    r"recomendado(\s+para\s+ti)?|recommand(e|é)(\s+pour\s+vous)?)\b"
)

CREDIT_AGENCIES = r"AFP|Getty(?:\s+Images)?|Reuters|dpa|Imagn"
JUNK_TITLE_RULES = (
    ("credit", rf"(?i)^(?:{CREDIT_AGENCIES})(?:\s*/\s*(?:{CREDIT_AGENCIES}))*$"),
    ("credit", rf"(?i)^(?:Image|Photo|Credit)\s*[:|]?\s*(?:{CREDIT_AGENCIES})\b"),
    ("credit", rf"(?i)^Courtesy\b.+\b(?:via|pool|Handout|{CREDIT_AGENCIES})\b"),
    ("credit", rf"(?i)\bHandout\b.+\b(?:{CREDIT_AGENCIES})\b|\b(?:{CREDIT_AGENCIES})\b.+\bHandout\b"),
    ("credit", rf"(?i)^(?:Live\s+Updates|Analysis)\s*[•·.:-]?\s*.*\b(?:{CREDIT_AGENCIES})\b"),
    ("cms_token", r"(?i)^(?:lucy\.\w[\w.-]*|methode[-.][\w.-]+)$"),
    ("json_blob", r"""^\{\s*["']?text["']?\s*:"""),
    ("slug", r"^[\p{L}\p{M}\p{Nd}]+(?:[-_][\p{L}\p{M}\p{Nd}]+){2,}$"),
    ("date_prefix", r"^[0-9]{4}(?:[\s.-]+[0-9]{1,2}){2}\b"),
    ("titleized_path", r"^(?:[0-9]+|\p{Lu}[\p{L}\p{M}]*)(?:\s+(?:[0-9]+|\p{Lu}[\p{L}\p{M}]*))*\s+[0-9]{6,}$"),
    ("video_chrome", r"(?i)^Clipped\s+From\s+Video\b"),
    ("video_chrome", r"(?i)^Video\s*[•·]"),
    ("template", r"(?i)^Created\s+from\s+Template\s+ID\b"),
    ("template", r"(\{\{[^}]+\}\}|%\{\w+\})"),
)
MIN_WORDS = 3

CTA = ("read more", "learn more")
TYPE_CHIPS = ("news article", "press release", "news")
SECTION_NAMES = ("press releases",)
MAX_DATE_CHARS = 128
CHIP_SEPARATORS = (" - ", " – ", " — ", " | ", " • ")
CLOCK_ZONE = (
    r"(?i)^\d{1,2}:\d{2}(?::\d{2})?(?:\s*(?:AM|PM))?"
    r"(?:\s+(?:[A-Za-z]+(?:/[A-Za-z_]+)+|(?:GMT|UTC)[+-]\d{1,2}(?::\d{2})?|[A-Za-z]{2,5}))?$"
)
DATE_SHAPES = (
    r"(?i)^\d{4}-\d{1,2}-\d{1,2}(?:[T ]\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)?$",
    r"^\d{1,2}[./-]\d{1,2}[./-]\d{2,4}(?: \d{1,2}:\d{2}(?::\d{2})?)?$",
    r"(?i)^\d{1,2}\.? \p{L}{3,9}\.?\s*,?\s*\d{4}(?: \d{1,2}:\d{2}(?::\d{2})?)?$",
    r"(?i)^\p{L}{3,9}\.? \d{1,2}\s*,?\s*\d{4}(?: \d{1,2}:\d{2}(?::\d{2})?)?$",
)

INTERSTITIALS = (
    ("cloudflare_interstitial", 2, (r"(?i)<title>\s*just a moment\.\.\.\s*</title>", r"(?i)checking your browser before accessing", r"(?i)please (?:enable|turn on) javascript and cookies", r"(?i)cdn-cgi/challenge-platform", r"(?i)cloudflare ray id")),
    ("datadome_interstitial", 2, (r"captcha-delivery\.com", r"(?i)DataDome", r"(?i)interstitial")),
    ("vercel_security_checkpoint", 1, (r"(?i)Vercel Security Checkpoint", r"(?i)vercel\.com/security", r"(?i)checking the security")),
)

#: Microdata names of a publish marker; characters and words of a text beside the title that describes.
PUBLISH_ITEMPROPS = ("datePublished", "dateModified")
CONTEXT_CHARS, CONTEXT_WORDS = 30, 8
#: Points of the quality and junk features of a segment.
QUALITY_POINTS = {"title_3_words": 40, "title_7_words": 15, "long_path": 20, "content_path": 15, "publish_marker": 15, "descriptive_context": 10, "article_container": 10, "content_tokens": 10}
JUNK_POINTS = {"utility_path": 25, "utility_prefix_title": 15, "shallow": 10, "no_marker_or_context": 10, "recommended_off_content": 10, "junk_path": 5, "junk_tokens": 15}

SKIP_HREF = ("#", "javascript:", "mailto:", "tel:", "file://", "sms:", "data:")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "br")
INVISIBLE = ("svg", "script", "noscript", "style", "template")
LANDMARKS = ("nav", "aside", "footer", "menu")
CHROME_ROOTS = ("nav", "footer", "header")
CARD_STOPS = (*LANDMARKS, *CHROME_ROOTS, "svg", "script", "style", "html", "body")
STRIPPED = ("script", "style", "noscript", "iframe", "svg", "template")
CLUSTER_EXCLUDED = ("html", "body", "nav", "footer", "header", "svg", "script", "style")
#: Words an element must have on average, points of a group, patterns of bold title classes and of dates in text.
CLUSTER_MIN_WORDS = 5
CLUSTER_POINTS = {"heading": 20, "time": 20, "date": 40}
BOLD_CLASS = "font-bold|font-semibold"
CLUSTER_DATE = r"\b\d{4}[-/]\d{2}[-/]\d{2}\b|\b(?i:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"
LAYOUT = ("div", "section", "article", "li", "ul", "ol")

#: The elements of a page that are kept, those kept beyond that many, and attributes kept by the start of their name.
MAX_NODES = 5000
DEGRADED_TAGS = ("html", "body", "article", "section", "li", "tr", "div", "a", "h1", "h2", "h3", "h4", "h5", "h6", "time", "img", "p", "ul", "ol", "main")
KEPT_ATTRIBUTES = "data-|aria-|class|id|href|src|srcset|style|datetime|itemprop|type|category|categories|tag|tags|topic|topics|section|sections|label|labels|theme|themes|subject|subjects"

UTILITY = sorted({*TAXONOMY, *CHROME, *SOFT_UTILITY})
HIGH_JUNK = sorted({*UTILITY} - {*SOFT_UTILITY})
