r"""Problem 1: template residue, filler, error pages and script notices.

Method: normalised lines are counted by host (document bitmaps, see ``lines``), recurrent
boilerplate is subtracted, and a record is excluded when what remains holds evidence.  Four kinds
of evidence are told apart: ``placeholder`` may stand anywhere in a line, ``error``, ``filler`` and
``script`` must be the whole line: a message is known by consisting of the words of such messages, not by its wording.  A placeholder counts in recurrent lines too, since boilerplate that
was never filled in is a case on each of its pages.  A record that consists of nothing but recurrent lines is judged
by those lines, so that an error page served under many addresses is still found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.lines import exploded_lines, frequent_lines, line_bitmaps, normal_line, source_name

# A trailing reference such as "(ref abcd-efgh)" doesn't belong to the message.
REFERENCE = r"(?:\s*[(\[](?:ref|id|node|trace|request|incident|ray|code)\b[ :#.]*[\w-]+[)\]])?\s*$"

# Lines may be of any length.  A group repeated without bound takes the possessive form ``{n,}+``, which is a loop in the regex engine where the
# plain one is a recursion that a long line breaks; each such group ends where the next word can't, so that nothing is lost by not going back.

# Words of the usual pseudo-Latin filler (fixed values).
LATIN = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa "
    "qui officia deserunt mollit anim id est laborum"
).split()

PLACEHOLDER = [
    r"\{\{(?!\s*mustache\b)[^{}\n]{0,80}\}\}",  # {{ name }}, {{{ name }}}
    r"\{%[^%\n]{1,80}%\}",
    r"(?:<|&lt;)%[^%\n]{1,80}%(?:>|&gt;)",
    r"\$\{[^{}\n]{1,60}\}",
    r"#\{[^{}\n]{1,60}\}",
    r"\{\$[\w.]+\}",
    r"\{(?:\d|[a-z_]+(?:[._][a-z]+)+)\}",
    r"%%\w+%%",
    r"##\w+##|@@\w+@@",
    r"%\([a-z_]+\)[sd]",
    r"(?:^|\s)%[sd](?=\s|$|[.,;:!?])",
    r"\[\[[\w .]{1,40}\]\]",
    r"\[(?:title|sitename|separator|phone|email|name|date|city|address|price|company|insert\b[^\]\n]{0,60}|your\b[^\]\n]{0,40}|gallery\b[^\]\n]{0,60})\]",
    r"\[/?(?:gallery|caption|embed|shortcode|vc_row|contact-form-7)\b[^\]\n]{0,80}\]",
    r"(?-i:\$[A-Z][A-Z_]{2,}\$?)",
    r"(?-i:(?<![A-Za-z0-9_])__[A-Z][A-Z_]*__)",
    r"(?-i:\b[A-Z]+_(?:TITLE|NAME|TEXT)_(?:PLACEHOLDER|HERE)\b)",
    r"(?-i:\b[A-Z]+_PLACEHOLDER\b)",
    r"(?-i:\bXX+-[A-Z]+-XX+\b)",
    r"(?:^|\s):[a-z]+_[a-z_]+\b",
    r"@(?:model|viewbag|viewdata)\.\w+",
    r"<(?:nombre|name|vorname|pr[eé]nom|first ?name|imi[eę]|nome|title goes here|your [a-z ]{1,30}|insert [a-z ]{1,30}|[a-z ]{1,30} (?:goes )?here)>",
    r"(?-i:\[[A-Z][A-Z]+(?:[ _-][A-Z]+)+\])",  # [FIRST NAME]
    r"\*\|[a-z_: ]{2,40}\|\*",
    r"\[object object\]",
    r"\btotal: nan\b|\bnan for undefined\b|^nan items\b|\bnan items \|",
    r"^(?:null|undefined)(?:\s*[-|–—·:]\s*\S.*)?$",
    r"^todo: ",
]
# Forms of error lines that say of themselves what they are: status codes, traces, server messages.
ERROR = [
    r"(?:http |http error |error |erreur |fehler(?:code)? |status )?[45]\d\d(?:\s*+[-–—:.]\s*+.{0,60})?",
    r"(?:http |error )?[45]\d\d (?:bad gateway|not found|service (?:temporarily )?unavailable|forbidden|internal server error|gateway time-?out|unauthorized|bad request|gone|too many requests)\b.{0,30}",
    r"fatal error: .{0,100}|warning: undefined .{0,120}|traceback \(most recent call last\):?.{0,100}|\w+error: '?[\p{L}\w./ -]{1,60}'?|\w*exception at .{1,80}|application error: .{0,100}|sqlstate\[\w+\]: .{0,120}|cannot (?:get|post) /\S*|stack trace:.{0,100}|error \d+.{0,60}",
]
# Text that nobody meant as content: pseudo-Latin, syllables, keys, names that editors give to new pages.
FILLER = [
    r"(?:(?:" + "|".join(LATIN) + r")\b[\s.,;:!?…-]*){2,}+(?:\w{1,12}…?)?",
    r"untitled(?: document| page)?|sample page|new page|home copy \d+|heading \d",
    r"(?:bla[ ,.]*){3,}+|(?:x{6,}+[ ,.]*|x{3,}+[ ,.]+(?=x))(?:x{3,}+[ ,.]*)*+|(?:(?:asdf|qwerty|jkl|test)[ ,.]*){3,}+|(?:(?:foo|bar|baz|qux)[ ,.]*){3,}+",
]

# Other messages are told by their words: a line of small words and words of messages, with one that makes it a message.  Fixed values, by language.
SMALL = (
    "something anything someone a an the this that these those it its you your we us our i my me to of in on at by for from with without and or but if is are was were be been being has have had do does did can could may might must should will would not no t s re ve ll don doesn didn isn aren wasn couldn won "
    "now here there again later soon please sorry as up out so just some all any one yet longer side own back only "
    "der die das den dem des ein eine einen ist sind war wurde werden wird hat haben kann konnte nicht kein keine sie wir ihr ihre ihren uns auf an im in zu zum zur um und oder von mit für bitte gleich mehr es "
    "le la les l un une des du de d cette ce ces est sont a été n pas ne vous votre nous sur dans pour et ou par plus s il elle que qui "
    "el los las una del en esta este no es está fue ha sido se su tu y o para por con sin favor más que lo "
    "o os as um uma da do na no esta este não é foi se seu sua e ou para por com sem mais "
    "il lo gli i una di del della questo questa non è stata stato si per con e che "
    "ta to ten nie jest nie na do w z i lub się aby tu prosimy proszę в на не и или для с по это эта этот было была был вы мы пожалуйста"
)
MESSAGE = (
    "before page pages site website file document resource url address link content server service gateway database connection network browser request requested requests session account user access permission security system application app shop store error errors code status http https internet host domain "
    "found find exist exists available unavailable reach reached respond responding answer connect connecting establish establishing load loading loaded open display displayed show view see run work works working properly process complete completed try trying return go home check checking looking look continue log login sign "
    "moved removed deleted renamed changed gone down offline closed suspended disabled expired blocked denied refused forbidden unauthorized invalid unknown wrong went broken failed failure internal bad temporarily currently time timed timeout exceeded limit rate many too slow maintenance maintained under construction undergoing scheduled occurred unexpected fatal moment wait attention required oops uh oh contact support administrator refresh reload retry enough"
)
MESSAGE_ELSEWHERE = (
    "seite seiten datei fehler fehlercode server dienst verbindung datenbank zugriff sitzung konto angeforderte gesuchte gefunden existiert verfügbar erreichbar vorübergehend verweigert gesperrt abgelaufen wartung wartungsarbeiten zurück versuchen erneut später anzeigen angezeigt geladen aufgetreten gewartet "
    "page fichier erreur serveur service connexion accès refusé refusée interdit interne introuvable trouvée trouvé existe disponible indisponible demandée recherchée désolé réessayez réessayer tard expiré expirée maintenance cours afficher "
    "página sitio archivo servidor servicio conexión acceso denegado sesión encontrada encontrado encontramos disponible existe solicitada error mantenimiento intente nuevo tarde caducado lo siento sentimos "
    "arquivo servidor serviço conexão acesso negado sessão encontrada encontrado disponível existe solicitada erro manutenção tente novamente tarde expirou desculpe "
    "pagina sito servizio connessione accesso negato trovata trovato esiste disponibile richiesta errore manutenzione riprova "
    "strona strony plik serwer usługa połączenie dostęp zabroniony istnieje znaleziono znaleziona dostępna błąd konserwacja spróbuj ponownie później "
    "страница страницы файл сервер доступ запрещен запрещён найдена найден существует доступна запрошенная ошибка соединение попробуйте позже обслуживание извините"
)
SCRIPT_WORDS = (
    "javascript js java script scripts scripting noscript enable enabled enabling require requires required need needs needed disabled turn turned switch switched activate activated support supported supports allow allowed off use using experience full "
    "skripte skript aktivieren aktiviert deaktiviert einschalten ohne benötigt erfordert unterstützt fortzufahren nutzen activer activez désactivé nécessite requiert sans navigateur utiliser "
    "desactivado habilita habilite habilitar activa active activar requiere navegador ver usar ative ativar desativado requer navegador continuar włącz wyłączony wymaga bez obsługę kontynuować przeglądarce przeglądarka включите отключен отключён требуется требует работы сайта браузере "
    "richiede abilita abilitare attiva attivare disabilitato senza browser utilizzare"
)
FILLER_WORDS = (
    "text texts content copy body headline heading title paragraph label button block section placeholder dummy sample default filler example insert add enter type put write edit change click double goes follow follows replace description caption image coming soon under construction check test ignore untitled lorem ipsum "
    "text blindtext platzhalter platzhaltertext beispieltext hier steht später richtige text texte remplissage à modifier plus tard contenu exemple contenido ejemplo texto relleno conteúdo exemplo testo esempio wpisz treść strony przykładowy tekst образец текст заполнитель"
)
NOT = r"(?:not|t|cannot|unable|no|nicht|keine?|pas|n|non|não|nie|не)"
_FAILED = r"(?:found|find|exists?|available|open|load(?:ed)?|respond|answer|connect|reach(?:ed)?|access|display(?:ed)?|process|complete|permission|gefunden|existiert|verfügbar|erreichbar|geladen|trouvée?|existe|disponible|encontrad[ao]|encontramos|disponível|trovat[ao]|esiste|disponibile|istnieje|znaleziono|znaleziona|найден[аы]?|существует|доступна)"
ERROR_SIGN = (
    r" (?:errors?|fehler|fehlercode|erreur|errore|erro|błąd|ошибка|oops|forbidden|denied|refused|unauthorized|unavailable|suspended|expired|timeout|timed out|maintenance|wartung|wartungsarbeiten|mantenimiento|manutenção|manutenzione|konserwacja|introuvable|indisponible|verweigert|denegado|negado|negato|refusée?|zabroniony|запрещ[её]н"
    r"|went wrong|too many|limit exceeded|gone|loading|just a moment|attention required|bad gateway|blocked|checking your browser|been (?:removed|deleted|moved|disabled)|gleich zurück) "
    rf"| {NOT}(?: \p{{L}}+){{0,4}} {_FAILED} | (?:existiert|existe|esiste) (?:\p{{L}}+ )?(?:nicht|pas|mehr) "
)
SCRIPT_SIGN = r" (?:javascript|js|java script|scripts?|scripting|noscript|skripte?|скрипты) "
SCRIPT_NEED = (
    r" (?:enabled?|enabling|requires?|required|needs?|needed|disabled|turn|switch|activated?|supports?|supported|allow|blocked|without|aktivieren|aktiviert|deaktiviert|ohne|benötigt|erfordert|unterstützt|activer|activez|désactivé|nécessite|requiert|sans"
    r"|desactivado|habilit[ae]r?|activar?|requiere|sin|ativ[ae]r?|desativado|requer|sem|włącz|wyłączony|wymaga|bez|включите|отключ[её]н|требует|требуется|richiede|abilitare?|attivare?|disabilitato|senza) "
)
SCRIPT_END = rf" (?:to (?:show|see|view|run|use|display|work|continue)|please|bitte|veuillez|por favor|proszę|aby|пожалуйста|для|um|pour|para|per|{NOT}) "
FILLER_SIGN = (
    r" (?:placeholder|dummy|blindtext|platzhalter|platzhaltertext|beispieltext|filler|remplissage|relleno|lorem|ipsum|coming soon|under construction|sample text|test page|default (?:heading|paragraph|title|text)|button label|contenido de ejemplo|texte? d exemple|texto de exemplo|testo di esempio|wpisz treść|заполнитель"
    r"|(?:your|own|insert|add|enter|body)(?: \p{L}+){0,3} (?:text|content|copy|headline|heading|title|description|label)(?: \p{L}+){0,2} (?:here|follow|follows)|your (?:headline|title|text|content)|(?:add|insert) your own (?:content|text)) "
)
FILLER_OF = r" (?:dummy copy|insert(?: \p{L}+){0,2} text here|placeholder for) "


# Any placeholder holds one of these; the check keeps the long alternation off plain lines.
HINT = r"(?iu)[{}<>\[$#@_|]|&lt;|%[(%sd]|:[a-z]+_|xx-[a-z]+-xx|\bnan\b|^null\b|^undefined\b|^todo"


def _anywhere(patterns: list[str]) -> str:
    return "(?iu)" + "|".join(f"(?:{p})" for p in patterns)


def _whole(patterns: list[str]) -> str:
    return r"(?iu)^\s*(?:" + "|".join(f"(?:{p})" for p in patterns) + ")" + REFERENCE


def _words(line: Column) -> Column:
    """The line's words in lower case, a space around each; without a trailing reference."""
    plain = F.when(line.rlike(r"[)\]]\s*$"), F.regexp_replace(line, "(?iu)" + REFERENCE, "")).otherwise(line)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(plain), r"\P{L}+", " ")), F.lit(" "))


def _strangers(words: Column, *vocabularies: str) -> tuple[Column, Column]:
    """The number of different words, and of those that none of the vocabularies has."""
    listed = F.array_distinct(F.split(F.trim(words), " "))
    known = F.split(F.lit(" ".join(vocabularies)), " ")  # folded to one constant
    return F.size(listed), F.size(F.array_except(listed, known))


def evidence(line: Column, words: Column | None = None) -> Column:
    """The kind of evidence that one line holds, or NULL; NULL and blank lines hold none.

    A message is a line whose words are all, or but for one in ten, small words and words of such messages; up to two strange
    words, a third of the line, may name the thing that is missing where a status code, a lack of permission or a request to allow scripts leaves no doubt.  ``words``: what ``_words`` gives, if it's there already.
    """
    words = _words(line) if words is None else words
    n, strange = _strangers(words, SMALL, MESSAGE, MESSAGE_ELSEWHERE)
    named = F.when(n <= 10, F.least(F.lit(2), F.floor(n / 3))).otherwise(F.floor(n / 10))
    sure = (line.rlike(r"\b[45]\d\d\b") & (n <= 8)) | words.rlike(" permission ")
    error = words.rlike(ERROR_SIGN) & (strange <= F.when(sure, named).otherwise(F.floor(n / 10)))
    n_script, strange = _strangers(words, SMALL, MESSAGE, MESSAGE_ELSEWHERE, SCRIPT_WORDS)
    script = words.rlike(SCRIPT_SIGN) & words.rlike(SCRIPT_NEED) & (strange <= F.when(words.rlike(SCRIPT_END), F.least(F.lit(2), F.floor(n_script / 3))).otherwise(F.floor(n_script / 10)))
    n_filler, strange = _strangers(words, SMALL, FILLER_WORDS, "page")
    filler = words.rlike(FILLER_SIGN + "|" + FILLER_OF) & (strange <= F.when(words.rlike(FILLER_OF), F.lit(2)).otherwise(F.floor(n_filler / 10)))
    return (
        F.when(line.rlike(HINT) & line.rlike(_anywhere(PLACEHOLDER)), "placeholder")
        .when(line.rlike(_whole(ERROR)), "error").when(script, "script").when(line.rlike(_whole(FILLER)) | filler, "filler").when(error, "error")
    )


def residue(df: DataFrame, id_col: str = "site_id", host_col: str = "domain", title_col: str = "page_title", text_col: str = "visible_text_preview", min_docs: int = 5, min_share: float = 0.2) -> DataFrame:
    """``(doc_id, kind)``: one row for each record with evidence, ``kind`` the least of its kinds.

    A line is recurrent boilerplate of its host if it stands in at least ``min_docs`` documents and in
    at least ``min_share`` of the host's documents; records without a host have none.  NULL counts as an
    empty text, an empty text has no evidence, rows delivered twice come out once, an empty table gives an
    empty result.  Only the lines of records that hold some evidence are joined with the boilerplate.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), F.col(title_col).alias("title"), F.col(text_col).alias("text")).where(F.col("doc_id").isNotNull())
    titled = rows.select("doc_id", "title", _words(F.col("title")).alias("words")).select("doc_id", evidence(F.col("title"), F.col("words")).alias("kind")).where(F.col("kind").isNotNull())

    lines = exploded_lines(rows, "doc_id", "host", "text")
    frequent = frequent_lines(line_bitmaps(lines.select("line_key", "doc_id")), min_docs)
    hosts = rows.select("doc_id", source_name(F.col("host")).alias("host")).where(F.col("host").isNotNull())
    sizes = hosts.groupBy("host", F.shiftright(F.col("doc_id").cast("bigint"), 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("doc_id").cast("bigint").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    sizes = sizes.groupBy("host").agg(F.sum(F.bit_count("bits")).alias("host_docs"))

    # What a line holds is looked up once: the row number, which isn't deterministic, keeps the filter from doing it again.
    lines_of = rows.where(F.col("text") != "").select("doc_id", source_name(F.col("host")).alias("host"), F.split("text", "\n").alias("lines"))
    judged_lines = lines_of.select("doc_id", "host", "lines", F.zip_with("lines", F.transform("lines", _words), evidence).alias("kinds"), F.monotonically_increasing_id().alias("_row"))
    marked = judged_lines.where(F.exists("kinds", lambda k: k.isNotNull())).select("doc_id", "host", F.explode(F.arrays_zip("lines", "kinds")).alias("x"))
    marked = marked.select("doc_id", "host", F.col("x.kinds").alias("kind"), normal_line(F.col("x.lines")).alias("norm")).where(F.col("norm") != "")
    marked = marked.select("doc_id", "host", "kind", F.xxhash64("host", "norm").alias("line_key"))
    judged = marked.join(frequent, "line_key", "left").join(sizes, "host", "left")
    recurrent = F.coalesce(F.col("n_docs") >= F.col("host_docs") * min_share, F.lit(False))
    by_doc = judged.groupBy("doc_id").agg(
        F.min(F.when(~recurrent | (F.col("kind") == "placeholder"), F.col("kind"))).alias("residual"),
        F.count_if(~recurrent).alias("n_residual"),
        F.min("kind").alias("anywhere"),
    )
    texts = by_doc.select("doc_id", F.when(F.col("n_residual") > 0, F.col("residual")).otherwise(F.col("anywhere")).alias("kind")).where(F.col("kind").isNotNull())
    return titled.unionByName(texts).groupBy("doc_id").agg(F.min("kind").alias("kind"))


def without_residue(df: DataFrame, id_col: str = "site_id", **names: str) -> DataFrame:
    """The rows of ``df`` whose record holds no evidence, all columns as they were."""
    bad = residue(df, id_col=id_col, **names).select(F.col("doc_id").alias("_residue_id"))
    return df.join(bad, df[id_col] == F.col("_residue_id"), "left_anti")
