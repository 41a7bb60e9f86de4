"""Problem 9: template residue, filler and machine messages in place of text.

Texts are cut into segments (lines, sentences); numbers and codes in them are
masked. Message templates are mined with a prefix tree of fixed depth: a segment
goes down by its length and first words to a leaf, and there joins the template
that agrees with it in enough positions, which gets a wildcard where they differ,
or starts one. Each template is classified once, by rules and by a classifier fitted here that
heeds in how many texts the template stands, and its verdict holds for all
segments it stands for. A document is residue if some segment is a message or filler
and none is ordinary text. Unfilled slots are looked for in every text on their own,
since they stand inside ordinary records too.

Only distinct masked segments, counted before the shuffle, are mined. What goes from texts to
verdicts is one 64-bit key for each segment.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.scratch import Scratch

#: Stands for a number or code in a segment or for different words of messages, and for other words in which the segments of a template differ.
WILD, OPEN = "<*>", "<?>"

#: Words of messages, navigation and filler in the four languages; small words that any text has.
MESSAGE_WORDS = frozenset("""
 page site website article application app resource content document file link view viewer server service gateway database connection
 request requests response status code error fault message reason exception traceback keyerror warning undefined null variable row line php srv loader nan
 internal unexpected condition met handling failed load loading responded timeout timed establishing down maintenance back unavailable temporarily unable
 denied access forbidden permission blocked ip unusual traffic login logon required sign signed register read session expired verify human captcha robot
 checking proceed retry slow javascript js script scripts scripting noscript browser browsers enable enabled disable disabled ad blocker support supports frames active
 functionality necessary allow run running turn switch reload requires built blank appear stays start viewed drawn unauthorized unauthorised continue
 found moved deleted exist exists requested asked looking gone broken longer available something went wrong oops sorry please try again later seconds minutes ms
 seite seiten anwendung inhalt dienst anfrage fehler interner kennung zugriff verweigert sitzung abgelaufen anmelden freigeben erreichbar vorübergehend zeitüberschreitung sekunden minuten
 erneut versuchen gefunden angeforderte existiert leider gelöscht verschoben ausgeschaltet leer aktivieren anzuzeigen sehen benötigt skript skripte blockiert aufgetreten ihr ihre dieser diese bitte wartung
 site contenu erreur interne survenue introuvable demandée demandé existe désolé accès refusé service momentanément indisponible veuillez activer afficher cette reconnecter votre
 navigateur exécute exécution nécessite bloqués bloqué peut délai dépassé secondes réessayez identifiez vous connecter expiré supprimé déplacé page maintenance nécessaire
 página sitio contenido servicio disponible temporalmente acceso denegado sesión caducado inicie navegador bloquea mostrarse puede active activar ver desactivado equipo necesita permitan
 produjo interno código tiempo agotado tras segundos inténtelo nuevo encontrada solicitada lamentablemente sentimos eliminado movido mantenimiento habilite
 http https resource too many bad caution seeing because off need happens nothing js
""".split())
FURNITURE_WORDS = frozenset("""
 home topics contact search menu privacy terms skip content back start reference no request id ref results help desk problem persists go open library archive notes bulletin
 title abstract summary loading case ward leaflet trial about cookies imprint copyright rights reserved next previous print share
 startseite suche impressum datenschutz accueil recherche mentions inicio buscar contacto kontakt menü yet here
""".split())
SMALL_WORDS = frozenset("""
 a an the and or of to in on at by for from with without this that these those it is are was were be been has have had do does did not no you your we our us my i if any all there here up out as so while can cannot could
 der die das den dem des ein eine einen und oder nicht kein ist sind war wird wurde werden sie ihr ihre im in auf von zu um mit nach für es
 le la les l un une des du de d et ou ne n pas est sont a été ce cette ces vous votre au aux en sur pour que qui s à après
 el los las un una unos y o no se su sus es son fue ha han que en con para por del al este esta estos lo tras
""".split())
#: What makes a segment of such words a message, what makes it filler, whole words as they stand.
TRIGGER = re.compile(
    r"javascript|noscript|\bjs\b|scripting|\bscripts?\b|\bskripte?\b|\bbrowser\b|navigateur|navegador|\berror\b|\bfehler\b|erreur|\bdenied\b|forbidden|verweigert|refusé|denegado|"
    r"session (has )?expired|sitzung|votre session|su sesión|sign in|log ?in|anmelden|identifiez|inicie sesión|not found|could not be found|introuvable|nicht gefunden|no encontrada|"
    r"no longer available|moved or deleted|supprimé|déplacé|gelöscht|verschoben|eliminado|movido|existiert|n existe|no existe|unable to service|down for maintenance|nicht erreichbar|indisponible|no disponible|"
    r"timed out|timeout|zeitüberschreitung|délai dépassé|tiempo agotado|too many requests|retry after|bad gateway|unusual traffic|verify that you|checking your|do not have permission|traceback|"
    r"undefined variable|failed to load|database connection|went wrong|link may be broken|status code|could not start|cannot be drawn|gone|unavailable|turn it on|enable it|switch on|unauthori[sz]ed|try again later|oops|freigeben|unexpected (<.> )?condition"
)
FILLER = re.compile(
    r"lorem|ipsum|dolor sit amet|sample text|placeholder copy|do not publish|your text here|insert (\w+ )*here|text goes here|beispieltext|blindtext|platzhaltertext|texte à remplacer|faux texte|texto de ejemplo|texto de relleno|"
    r"\b(asdf|qwer|qwerty|foo bar)\b|\bx{3,}\b|nothing here yet|coming soon|null (null|undefined)|undefined null|(\btest\b( <\*>)? ?){3,}|(\btext\b ?){4,}|under construction"
)

_NAME = r"[A-Za-z_][\w.\-]*(?: [A-Za-z_][\w.\-]*){0,2}"
#: Fixed value: forms of an unfilled slot; brackets of ordinary text (numbers, sets, JSON, [sic], tags) are none.
SLOT = re.compile(
    r"\{\{\{?\s*[#/^&>!]?\s*" + _NAME + r"\s*\}?\}\}|\$\{\s*" + _NAME + r"\s*\}|\{%-?\s*" + _NAME + r"[^{}%]{0,40}%\}|\{\s*[#/]?" + _NAME + r"\s*\}|\{\d\}|<%=?\s*" + _NAME + r"\s*%>|"
    r"«" + _NAME + r"»|<<\s*" + _NAME + r"\s*>>|%\(" + _NAME + r"\)[sdif]|%[A-Za-z_][\w.]*(?: [A-Za-z_]+)?%|(?<!\w)%s(?!\w)|@@" + _NAME + r"@@|__[A-Za-z]\w*?__|\[\[\s*" + _NAME + r"\s*\]\]|_{5,}|\(\(\s*" + _NAME + r"\s*\)\)|\$\(\s*" + _NAME + r"\s*\)|(?<![\w?:#|!~&])(?P<q>[?:#|!~&])" + _NAME + r"(?P=q)(?![\w?:#|!~&])|"
    r"\[\s*(?:insert|your|missing|enter|add|fill in|placeholder|einfügen|insérer|insertar)\b[^\[\]\d]{0,40}\]|\[[^\[\]]{1,40}: ?(?:to be completed|tbd|todo|fill in)\]",
    re.IGNORECASE,
)
_OPEN = re.compile(r"[{$%<«@\[_(?:#|!~&](?=[A-Za-z_({\[<%@ \s#/^>!=0-9])")
_SQUARE = re.compile(r"\[\s*([A-Za-z_][\w.]*(?: [A-Za-z_]\w*)?)\s*\]")
_ANGLE = re.compile(r"<\s*([A-Za-z_][\w.]*(?: [A-Za-z_]\w*)?)\s*>")
#: Editorial marks in square brackets, and tag names.
EDITORIAL = frozenset("sic ci emphasis et al ibid note ref refs citation needed redacted applause laughter pause inaudible translated abstract article in press comment letter review ed eds".split())
TAGS = frozenset("""a abbr article aside b big blockquote body br button caption center code col dd div dl dt em fault figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main mark
 meta nav noscript ol option p pre q reason s script section select small span strike strong style sub sup svg table tbody td textarea tfoot th thead title tr tt u ul var video""".split())


def has_slot(text: str) -> bool:
    """Whether some template slot was left unfilled."""
    if "&" in text and "&lt;" in text.lower():
        text = html.unescape(text)
    # A slot can only begin at one of these; other places are not tried.
    for m in _OPEN.finditer(text):
        if SLOT.match(text, m.start()):
            return True
    for m in _SQUARE.finditer(text) if "[" in text else ():
        if not all(w in EDITORIAL for w in m[1].lower().split()) and text[m.end() : m.end() + 1] != "(":
            return True
    if "<" not in text:
        return False
    low = text.lower()
    return any(m[1].lower().split()[0] not in TAGS and f"</{m[1].lower()}>" not in low for m in _ANGLE.finditer(text))


_CUT = re.compile(r"[\r\n]+|<br\s*/?>|(?<=[.!?])\s+", re.IGNORECASE)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_TOKEN = re.compile(r"[^\W_]+")


def segments(text: str) -> list[str]:
    """Masked segments: words in lower case, one blank between them, a wildcard for every word with a digit or another number."""
    out = []
    for x in _CUT.split(text.lower()):
        t = [w if w.isalpha() else WILD for w in _TOKEN.findall(_TAG.sub(" ", x) if "<" in x else x)]
        if t:
            out.append(" ".join(t))
    return out


def classify(template: str) -> str:
    """``message``, ``filler``, ``furniture`` or ``ordinary``. Places where segments differ count as words that are not known."""
    t = template.split(" ")
    w = [x for x in t if x != WILD]
    if FILLER.search(template):
        # Other words around a piece of filler make it text that speaks of it.
        rest = [x for x in FILLER.sub(" ", template).split() if x != WILD and x not in SMALL_WORDS and x not in FURNITURE_WORDS]
        if len(rest) <= max(2, len(w) // 3) or re.search(r"lorem|ipsum|dolor", template):
            return "filler"
    if len(w) >= 6 and len(set(w)) * 3 <= len(w):
        return "filler"
    known = sum(x in MESSAGE_WORDS or x in FURNITURE_WORDS or x in SMALL_WORDS for x in w)
    if w and TRIGGER.search(template) and known >= 0.75 * len(w):
        return "message"
    if len(w) <= 3 or sum(x in FURNITURE_WORDS or x in SMALL_WORDS for x in w) >= 0.75 * len(w):
        return "furniture"
    return "ordinary"


#: Messages and filler from which the classifier learns, one after another, in the four languages.
SEEDS = """
this content is not available in your country|this video is not available in your region|the requested content is not available|sorry this item is currently unavailable|content unavailable|video unavailable
request limit reached|rate limit reached please wait|quota exceeded|too many attempts try again later|api limit exceeded|connection limit exceeded|maximum number of requests exceeded
proxy error|bad gateway|gateway error|upstream connect error or disconnect|web server is down|origin is unreachable|the proxy server received an invalid response|service error
segmentation fault|core dumped|fatal error|null pointer exception|out of memory|stack overflow|unhandled exception at line|permission denied|command not found|no such file or directory|connection refused|connection reset by peer|broken pipe|bus error
your connection is not secure|this connection is not private|the certificate has expired|certificate error|invalid security token|secure connection failed|ssl handshake failed|attackers might be trying to steal your information
you must accept cookies to view this content|please accept cookies|cookies are required to continue|please enable cookies|we use cookies to give you the best experience|accept all cookies to proceed
due to a technical problem this page cannot be displayed|owing to technical difficulties this service is not available|this article could not be loaded|the content cannot be displayed at this time|unable to display this page|this site cannot be reached
an unexpected error occurred|something went wrong|please reload the page|refresh your browser|your browser is not supported|please update your browser|please turn on javascript|scripts must be enabled|this page needs javascript
page not found|file not found|we could not find that page|the page has moved|the link is broken|this page no longer exists|the address was not found on this server
access denied|you are not authorised to view this page|forbidden|please log in to continue|your session has timed out|you have been logged out|invalid user name or password|subscribe to read the full text|members only
service unavailable|scheduled maintenance|we will be back soon|server is too busy|internal server error|request timed out|the server did not respond|database error|could not connect to the server
please complete the captcha|confirm that you are not a robot|checking if the site connection is secure|your ip address has been blocked|automated access detected
content to be supplied|text to be added|to be completed|content coming soon|description to be added|your text goes here|enter your text here|placeholder text|dummy text|this is sample content|insert text|add content here|no content yet|todo
hier steht ihr text|ihr text steht hier|hier text einfügen|platzhalter|mustertext|inhalt folgt|text folgt|in kürze verfügbar|diese seite wird gerade überarbeitet
dieser inhalt ist in ihrem land nicht verfügbar|seite nicht gefunden|ein fehler ist aufgetreten|bitte versuchen sie es später erneut|bitte aktivieren sie javascript|sie haben keine berechtigung|die verbindung ist nicht sicher|zu viele anfragen|der server antwortet nicht|cookies müssen akzeptiert werden|wegen technischer probleme nicht verfügbar|ihre sitzung ist abgelaufen|ihr browser wird nicht unterstützt
ce contenu n est pas disponible dans votre pays|page introuvable|une erreur est survenue|veuillez réessayer plus tard|veuillez activer javascript|vous n avez pas accès à cette page|la connexion n est pas sécurisée|trop de requêtes|le serveur ne répond pas|vous devez accepter les cookies|en raison de problèmes techniques|votre session a expiré|votre navigateur n est pas pris en charge|votre texte ici|texte à compléter|contenu à venir
este contenido no está disponible en su país|página no encontrada|se ha producido un error|inténtelo de nuevo más tarde|active javascript|no tiene permiso para ver esta página|la conexión no es segura|demasiadas solicitudes|el servidor no responde|debe aceptar las cookies|por problemas técnicos no está disponible|su sesión ha caducado|su navegador no es compatible|su texto aquí|texto por completar|contenido próximamente
"""


def _features(template: str) -> list[int]:
    """Hashed words, pairs of neighbours and stems of a template; wildcards tell nothing."""
    w = [x for x in template.split(" ") if x not in (WILD, OPEN)]
    f = [*w, *(x[:5] + "~" for x in w if len(x) > 5), *map(" ".join, zip(w, w[1:]))]
    return [xxhash.xxh3_64_intdigest(x) & 0xFFFF for x in f]


class Classifier:
    """Naive Bayes over hashed features: messages and filler against ordinary segments.

    It learns from the seeds and from a bounded sample of the corpus' own templates, those
    that the rules call ordinary; half of that sample is held out and sets the scores
    above which a template is a message, within bounds: ``alone`` is meant to let 1 in 2,000 ordinary
    ones pass, ``repeated``, for templates that many texts hold, 1 in 200.
    """

    def __init__(self, ordinary: list[str]):
        import numpy as np

        seeds = [s.strip() for line in SEEDS.strip().splitlines() for s in line.split("|")]
        ordinary = sorted(set(ordinary))
        learn, held = ordinary[::2], ordinary[1::2]
        pos, neg = np.full(1 << 16, 0.05), np.full(1 << 16, 0.05)
        for texts, c in ((seeds, pos), (learn, neg)):
            for t in texts:
                for f in set(_features(t)):
                    c[f] += 1
        # The sample may hold messages that the rules don't know: a single sighting of a word in a small one must not outweigh a seed.
        self.weight = (np.log(pos / (len(seeds) + 0.1)) - np.log(neg / max(len(learn), 2000))).clip(-4, 4)
        self.weight[(pos < 1) & (neg < 1)] = -0.5  # never seen
        scores = sorted((self.score(t) for t in held), reverse=True)
        at = lambda share, least: min(least + 0.2, max(least, scores[min(len(scores) - 1, int(share * len(scores)))])) if scores else least
        self.alone, self.repeated = at(1 / 2000, 0.8), at(1 / 200, 0.7)

    def score(self, template: str) -> float:
        """Mean weight of the features; a template of more words than a message has scores low."""
        f = _features(template)
        return float(sum(self.weight[f]) / (len(f) + 1)) - max(0, template.count(" ") - 24) * 0.1 if f else -4.0

    def verdict(self, template: str, support: int) -> str:
        """The rules' verdict, unless they know no message in it and the classifier does."""
        v = classify(template)
        w = [x for x in template.split(" ") if x != WILD]
        # Single words and mere furniture tell too little to learn from.
        if v in ("message", "filler") or len(w) < 2 or all(x in FURNITURE_WORDS or x in SMALL_WORDS for x in w):
            return v
        return "message" if self.score(template) > (self.repeated if support >= REPEATED else self.alone) else v


#: Texts that hold a template before it counts as repeated, and templates of the sample that fits the classifier.
REPEATED, SAMPLE = 5, 20_000


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slots, keys, segs = [], [], []
        for t in b.column(1).to_pylist():
            slots.append(has_slot(t))
            s = list(dict.fromkeys(segments(t)))
            segs.append(s)
            keys.append([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in s])
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(slots, pa.bool_()), pa.array(keys, pa.list_(pa.int64())), pa.array(segs, pa.list_(pa.string()))], ["id", "slot", "keys", "segs"])


_KNOWN = MESSAGE_WORDS | FURNITURE_WORDS | SMALL_WORDS | {WILD}


def merged(x: str, y: str) -> str:
    """What a template has where its segments differ: a wildcard if all that stands there belongs to messages, else an open place."""
    return x if x == y else WILD if x in _KNOWN and y in _KNOWN else OPEN


class Leaf:
    """The templates of one leaf of the tree.

    A segment joins the template with which it agrees in the most positions, the first of
    equals, if those are ``share`` of all. With so many positions to agree in, of one more
    than may differ some position agrees: only templates that a posting list of those
    positions names are compared, the shortest lists being taken.
    """

    FEW = 6

    def __init__(self, share: float):
        self.share, self.templates, self.support, self.post = share, [], [], None

    def _index(self, i: int, positions) -> None:
        t = self.templates[i]
        for p in positions:
            self.post.setdefault((p, t[p]), []).append(i)

    def add(self, t: list[str], support: int) -> int:
        n = len(t)
        need = -(-self.share * n // 1)
        if self.post is None and len(self.templates) > self.FEW:
            self.post = {}
            for i in range(len(self.templates)):
                self._index(i, range(n))
        if self.post is None:
            near = range(len(self.templates))
        else:
            lists = sorted((self.post.get((p, x), ()) for p, x in enumerate(t)), key=len)
            near = sorted({i for x in lists[: n - int(need) + 1] for i in x})
        best, which = need - 1, -1
        for i in near:
            k = sum(map(str.__eq__, t, self.templates[i]))
            if k > best:
                best, which = k, i
                if k == n:
                    break
        if which < 0:
            which = len(self.templates)
            self.templates.append(t)
            self.support.append(0)
            if self.post is not None:
                self._index(which, range(n))
        elif best < n:
            m = self.templates[which]
            self.templates[which] = [merged(x, y) for x, y in zip(m, t)]
            if self.post is not None:
                self._index(which, [p for p in range(n) if self.templates[which][p] != m[p]])
        self.support[which] += support
        return which


def _mine(share: float, held: int, name):
    """Streams rows (leaf, key, seg, df) sorted by leaf and segment; gives (key, g, template, df): the template of each key, and, where key is null, each template.

    ``name(template words, support)`` is what stands in the column ``template``. A leaf with more than
    ``held`` templates lets go of them all and starts again, so that memory is bounded; what
    the order has brought together, neighbours in the alphabet, has met by then.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaf, part, keys, ids, rows = None, Leaf(share), 0, [], [], []

        def close():
            nonlocal leaf, part
            for i, (t, n) in enumerate(zip(leaf.templates, leaf.support)):
                rows.append((None, xxhash.xxh3_64_intdigest(f"{at}\t{part}\t{i}") - (1 << 63), name(" ".join(t), n), n))
            leaf, part = Leaf(share), part + 1

        def give():
            k, g, t, n = zip(*rows)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(g, pa.int64()), pa.array(t, pa.string()), pa.array(n, pa.int64())], ["key", "g", "template", "df"])

        for b in batches:
            for where, key, seg, df in zip(*(c.to_pylist() for c in b.columns[:4])):
                if where != at:
                    if at is not None:
                        close()
                    at, part = where, 0
                elif len(leaf.templates) >= held:
                    close()
                i = leaf.add(seg.split(" "), df)
                rows.append((key, xxhash.xxh3_64_intdigest(f"{at}\t{part}\t{i}") - (1 << 63), None, df))
                if len(rows) >= 20000:
                    yield give()
        if at is not None:
            close()
        if rows:
            yield give()

    return run


def mine_templates(docs: DataFrame, s: Scratch, *, depth: int = 3, share: float = 0.7, held: int = 8192, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame]:
    """(key, verdict) of every distinct segment, of the read texts ``docs`` (id, slot, keys, segs), that is not ordinary, and (template, verdict, n_texts) of all templates.

    Segments descend twice: by their length and first ``depth`` words, and the templates of
    that tree by their length and last ones, so that those that differ at the front meet too.
    """
    x = docs.select(F.explode(F.arrays_zip("keys", "segs")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.min("x.segs").alias("seg"), F.count("*").alias("df"))
    schema = "key long, g long, template string, df long"

    def tree(f: DataFrame, ends: Column, name) -> DataFrame:
        leaf = F.concat_ws(" ", F.size(F.split("seg", " ")).cast("string"), ends)
        f = f.select(leaf.alias("leaf"), "key", "seg", "df").repartition("leaf").sortWithinPartitions("leaf", "seg", "key")
        return s.cut(f.mapInArrow(_mine(share, held, name), schema))

    first = tree(x, F.slice(F.split("seg", " "), 1, depth), lambda t, n: t)
    templates = first.filter("key is null").select(F.col("g").alias("key"), F.col("template").alias("seg"), "df")
    # The same rows at every run: the least keys. They are few, and so is what the classifier keeps of them.
    fit = [r.seg for r in templates.orderBy("key").limit(sample).collect()]
    model = Classifier([t for t in fit if classify(t) == "ordinary"])
    second = tree(templates, F.reverse(F.slice(F.reverse(F.split("seg", " ")), 1, depth)), lambda t, n: f"{model.verdict(t, n)} {t}")
    final = second.filter("key is null").select("g", F.split("template", " ", 2).alias("p"), "df").select("g", F.col("p")[1].alias("template"), F.col("p")[0].alias("verdict"), "df")
    told = final.filter("verdict <> 'ordinary'").select("g", "verdict")
    to = second.filter("key is not null").select(F.col("key").alias("g1"), "g").join(told, "g").select("g1", "verdict")
    flagged = first.filter("key is not null").select("key", F.col("g").alias("g1")).join(to, "g1").select("key", "verdict")
    return flagged, final.select("template", "verdict", F.col("df").alias("n_texts"))


def residue(docs: DataFrame, ident: str, text: str, **mining) -> DataFrame:
    """(id, has_slot, n_message, n_filler, is_residue) of every text that holds a slot, a message or filler.

    Null and blank texts and null ids are left out; rows of one id that repeat
    count once, and an id with several texts is residue if one of them is. Texts of
    any length are read whole. Other columns are ignored; an empty table gives an
    empty table.
    """
    s, seen = _seen(docs, ident, text)
    flagged, _ = mine_templates(seen, s, **mining)
    flagged = s.cut(flagged)
    # Texts, told apart by their segments, may share an id.
    each = seen.select("id", "slot", F.hash("keys").alias("h"), F.explode_outer("keys").alias("key"))
    v = each.join(flagged, "key", "left").groupBy("id", "h").agg(
        F.max("slot").alias("has_slot"),
        F.count_if(F.col("verdict") == "message").alias("n_message"),
        F.count_if(F.col("verdict") == "filler").alias("n_filler"),
        F.count_if(F.col("verdict").isNull() & F.col("key").isNotNull()).alias("n_ordinary"),
    )
    bad = F.col("has_slot") | ((F.col("n_message") + F.col("n_filler") > 0) & (F.col("n_ordinary") == 0))
    v = v.withColumn("is_residue", bad).groupBy("id").agg(F.max("has_slot").alias("has_slot"), F.max("n_message").alias("n_message"), F.max("n_filler").alias("n_filler"), F.max("is_residue").alias("is_residue"))
    return v.filter("has_slot or n_message > 0 or n_filler > 0")


def templates(docs: DataFrame, ident: str, text: str, **mining) -> DataFrame:
    """(template, verdict, n_texts): every template of the texts, and how many distinct texts or repeats hold it."""
    s, seen = _seen(docs, ident, text)
    return mine_templates(seen, s, **mining)[1]


def _seen(docs: DataFrame, ident: str, text: str) -> tuple[Scratch, DataFrame]:
    s = Scratch(docs.sparkSession, "residue")
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("t")).filter(F.col("id").isNotNull() & F.col("t").rlike(r"\S"))
    return s, s.cut(rows.mapInArrow(_read, "id long, slot boolean, keys array<long>, segs array<string>"))
