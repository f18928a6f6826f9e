"""Texts of error pages, script notices, filler and placeholders, put together from parts.

The parts are fixed values written from general knowledge of web servers,
content systems and browsers; the README says how they relate to the test tables.
``FAMILIES`` makes texts of
one kind each from a seeded generator, so that a whole kind can be left out of
a fit and used to measure it.
"""

from __future__ import annotations

import random
import re
from http import HTTPStatus

# What error pages say, by language, as (subjects, predicates, advice).
LOST = {
    "en": (["The page", "This page", "That document", "The article", "The file you asked for", "The link you followed", "The resource", "The content"], ["could not be found", "does not exist any more", "has been removed", "was deleted", "is missing", "has moved to another address", "cannot be located", "is not here", "has expired", "was taken offline", "is no longer available", "is unavailable"], ["Check the spelling", "Try the search box", "Return to the homepage", "Go to the front page", "Please update your bookmarks", "The link may be broken or outdated", "Perhaps you mistyped the address", "Here are some helpful links instead"]),
    "de": (["Die Seite", "Diese Datei", "Der Artikel", "Das Dokument", "Der Inhalt", "Die Adresse"], ["wurde nicht gefunden", "existiert nicht mehr", "wurde entfernt", "ist umgezogen", "ist nicht verfügbar", "konnte nicht gefunden werden", "wurde gelöscht"], ["Prüfen Sie die Schreibweise", "Zurück zur Startseite", "Nutzen Sie die Suche", "Der Link ist vermutlich veraltet"]),
    "fr": (["La page", "Ce document", "L'article", "Le fichier", "Le contenu", "Cette adresse"], ["est introuvable", "n'existe plus", "a été supprimé", "a été déplacée", "n'est plus disponible", "n'a pas été trouvé"], ["Vérifiez l'orthographe", "Retour à l'accueil", "Utilisez la recherche", "Le lien est peut-être périmé"]),
    "es": (["La página", "Este documento", "El artículo", "El archivo", "El contenido", "Esta dirección"], ["no se encuentra", "no existe", "ha sido eliminado", "se ha movido", "ya no está disponible", "no pudo encontrarse"], ["Revise la ortografía", "Vuelva al inicio", "Use el buscador", "El enlace puede estar roto"]),
    "pt": (["A página", "Este documento", "O artigo", "O arquivo", "O conteúdo", "Este endereço"], ["não foi encontrada", "não existe", "foi removido", "mudou de lugar", "não está mais disponível", "não pôde ser encontrado"], ["Confira a grafia", "Volte para o início", "Use a busca", "O link pode estar quebrado"]),
    "ja": (["ページ", "指定されたファイル", "この記事", "アクセスしたURL"], ["は見つかりません", "は存在しません", "は削除されました", "は移動しました", "は公開を終了しました"], ["トップページへ戻ってください", "URLをご確認ください", "検索をお試しください"]),
}
BROKEN = {
    "en": (["The server", "Our server", "The application", "The site", "This service", "The backend", "The database", "Something", "The gateway", "Your request", "The connection"], ["ran into a problem", "failed to answer", "did not respond in time", "is overloaded", "is offline for maintenance", "returned an invalid response", "crashed unexpectedly", "is temporarily unavailable", "is undergoing scheduled maintenance", "went wrong on our side", "could not be processed", "was interrupted", "timed out", "was refused", "has failed with an unknown error"], ["Please try again later", "Try again in a few minutes", "Reload the page", "Refresh your browser", "Contact the administrator if this goes on", "We have been notified and are working on a fix", "We apologise for the inconvenience", "We will be back soon", "Please come back in N minutes", "Quote the incident number H when you write to us", "Thank you for your patience", "Please try again shortly"]),
    "de": (["Der Server", "Die Anwendung", "Der Dienst", "Die Verbindung", "Ihre Anfrage", "Die Datenbank"], ["antwortet nicht", "ist überlastet", "wird gewartet", "ist vorübergehend nicht erreichbar", "konnte nicht verarbeitet werden", "hat einen Fehler gemeldet", "wurde unterbrochen", "ist abgestürzt"], ["Bitte versuchen Sie es in N Minuten wieder", "Laden Sie die Seite neu", "Wir arbeiten an der Behebung", "Wir bitten um Entschuldigung", "Ein unerwarteter Fehler ist aufgetreten", "Bitte versuchen Sie es später erneut", "Danke für Ihre Geduld"]),
    "fr": (["Le serveur", "L'application", "Le service", "La connexion", "Votre demande", "La base de données"], ["ne répond pas", "est surchargé", "est en maintenance", "est momentanément indisponible", "n'a pas pu être traitée", "a rencontré un problème", "a été interrompue"], ["Veuillez réessayer dans N minutes", "Rechargez la page", "Nous travaillons à une solution", "Une erreur inattendue est survenue", "Veuillez nous excuser", "Veuillez réessayer plus tard", "Merci de votre patience"]),
    "es": (["El servidor", "La aplicación", "El servicio", "La conexión", "Su solicitud", "La base de datos"], ["no responde", "está saturado", "está en mantenimiento", "no está disponible por el momento", "no pudo procesarse", "ha tenido un problema", "se interrumpió"], ["Inténtelo de nuevo en N minutos", "Recargue la página", "Estamos trabajando para resolverlo", "Se ha producido un error inesperado", "Disculpe las molestias", "Vuelva a intentarlo más tarde", "Gracias por su paciencia"]),
    "pt": (["O servidor", "O aplicativo", "O serviço", "A conexão", "Sua solicitação", "O banco de dados"], ["não responde", "está sobrecarregado", "está em manutenção", "está indisponível no momento", "não pôde ser processada", "teve um problema", "foi interrompida"], ["Tente de novo em N minutos", "Recarregue a página", "Estamos trabalhando na correção", "Ocorreu um erro inesperado", "Pedimos desculpas", "Tente novamente mais tarde", "Obrigado pela paciência"]),
    "ja": (["サーバー", "システム", "サービス", "データベース", "接続"], ["が応答しません", "は現在メンテナンス中です", "が混み合っています", "でエラーが起きました", "が中断されました", "は一時的に利用できません"], ["時間をおいて再度お試しください", "ページを再読み込みしてください", "ご迷惑をおかけします", "予期しないエラーです", "後でもう一度お試しください"]),
}
# The usual translations of the reason phrases of HTTP.
REASONS = {
    "de": ["Ungültige Anfrage", "Nicht gefunden", "Seite nicht gefunden", "Zugriff verweigert", "Interner Serverfehler", "Dienst nicht verfügbar", "Fehlerhaftes Gateway", "Zeitüberschreitung", "Zu viele Anfragen", "Nicht autorisiert", "Verboten", "Fehler 404", "Wartungsarbeiten"],
    "fr": ["Requête incorrecte", "Non trouvé", "Page introuvable", "Page non trouvée", "Accès refusé", "Erreur interne du serveur", "Service indisponible", "Mauvaise passerelle", "Délai dépassé", "Trop de requêtes", "Non autorisé", "Interdit", "Erreur 404", "Maintenance en cours"],
    "es": ["Solicitud incorrecta", "No encontrado", "Página no encontrada", "Acceso denegado", "Error interno del servidor", "Servicio no disponible", "Puerta de enlace incorrecta", "Tiempo de espera agotado", "Demasiadas solicitudes", "No autorizado", "Prohibido", "Error 404", "Sitio en mantenimiento"],
    "pt": ["Solicitação inválida", "Não encontrado", "Página não encontrada", "Acesso negado", "Erro interno do servidor", "Serviço indisponível", "Gateway inválido", "Tempo esgotado", "Muitas solicitações", "Não autorizado", "Proibido", "Erro 404", "Site em manutenção"],
    "ja": ["不正なリクエスト", "見つかりません", "ページが見つかりません", "アクセスが拒否されました", "内部サーバーエラー", "サービス利用不可", "ゲートウェイエラー", "タイムアウト", "リクエストが多すぎます", "認証が必要です", "エラー404", "メンテナンス中"],
}
# Messages that web servers, proxies and script frameworks send by default.
STANDARD = ["The requested URL /P was not found on this server.", "The requested URL was rejected. Please consult with your administrator.", "You don't have permission to access this resource.", "The server encountered an internal error or misconfiguration and was unable to complete your request.", "The proxy server received an invalid response from an upstream server.", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems.", "Your browser sent a request that this server could not understand.", "Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request.", "The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.", "This site can't be reached", "The request timed out", "upstream request timeout", "no healthy upstream", "Application error: a client-side exception has occurred", "This page isn't working", "The page isn't redirecting properly", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "You need to enable JavaScript to run this app.", "Enable JavaScript and cookies to continue", "Sorry, you have been blocked", "Error establishing a database connection", "There has been a critical error on this website.", "Oops! That page can't be found.", "It looks like nothing was found at this location.", "Hmm, we could not find that page.", "Whoops, looks like something went wrong.", "An unexpected error has occurred.", "Gateway timed out while waiting for /P", "Timeout while fetching /P"]
REFUSED = {
    "en": ["You are not allowed to see this page", "You need to sign in first", "Log in to read the rest", "Permission denied", "You don't have access to this document", "Your account lacks the rights for this resource", "This area is for members only", "Your session timed out, please log in again", "Your login has ended", "Authentication required", "Access to this page is restricted", "Your address has been blocked", "Forbidden", "Not authorised", "Invalid or missing security token", "You have been signed out"],
    "de": ["Sie dürfen diese Seite nicht sehen", "Bitte melden Sie sich an", "Anmeldung erforderlich", "Keine Berechtigung", "Zugang gesperrt", "Ihre Sitzung ist abgelaufen", "Dieser Bereich ist geschützt", "Der Zugriff wurde abgelehnt"],
    "fr": ["Vous n'avez pas le droit de voir cette page", "Veuillez vous connecter", "Connexion requise", "Autorisation refusée", "Accès interdit", "Votre session a expiré", "Cet espace est réservé aux membres"],
    "es": ["No tiene permiso para ver esta página", "Inicie sesión para seguir", "Permiso denegado", "Acceso restringido", "Su sesión ha caducado", "Esta zona es solo para miembros", "Prohibido el acceso"],
    "pt": ["Você não tem permissão para ver esta página", "Entre na sua conta para continuar", "Permissão negada", "Acesso restrito", "Sua sessão expirou", "Esta área é só para membros", "Acesso proibido"],
    "ja": ["このページを見る権限がありません", "ログインが必要です", "アクセスは禁止されています", "セッションの有効期限が切れました", "会員専用のページです"],
}
SCRIPTS = {
    "en": (["JavaScript", "scripts", "scripting", "active scripting", "client-side scripts", "cookies and JavaScript"], ["Turn on V", "Enable V", "Activate V", "Allow V", "Switch V on", "Please enable V", "You must turn V on", "You will need V"], ["to use this site", "to view the content", "in the settings of your browser", "and reload", "to continue", "to see this page", "to display this document", "to open the viewer", "in order to read on"], ["This site requires V", "The application needs V", "This viewer does not work without V", "The page relies on V", "Our portal cannot run without V", "V seems to be turned off", "V is blocked in your browser", "V has been disabled", "noscript", "This browser is too old", "Your browser does not support this application", "Please update your browser", "This interactive guide cannot start because V is off", "Without V nothing can be shown", "Scripts are off, so the page stays empty", "Scripting is disabled here"]),
    "de": (["JavaScript", "Skripte"], ["Schalten Sie V ein", "Aktivieren Sie V", "Erlauben Sie V", "Bitte erlauben Sie V"], ["um die Seite zu sehen", "in Ihrem Browser", "und laden Sie neu", "um fortzufahren"], ["Diese Seite benötigt V", "Die Anwendung läuft nicht ohne V", "V ist ausgeschaltet", "Ihr Browser ist veraltet", "Für die Anzeige wird V gebraucht"]),
    "fr": (["JavaScript", "les scripts"], ["Activez V", "Autorisez V", "Merci d'activer V", "Il faut activer V"], ["pour voir la page", "dans votre navigateur", "puis rechargez", "pour continuer"], ["Ce site a besoin de JavaScript", "L'application ne marche pas sans V", "JavaScript est désactivé", "Votre navigateur est trop ancien", "Le contenu exige JavaScript"]),
    "es": (["JavaScript", "los scripts"], ["Active V", "Habilite V", "Permita V", "Es necesario activar V"], ["para ver el contenido", "en su navegador", "y recargue", "para continuar"], ["Este sitio necesita JavaScript", "La aplicación no funciona sin V", "JavaScript está desactivado", "Su navegador es demasiado antiguo", "Se requiere JavaScript"]),
    "pt": (["JavaScript", "os scripts"], ["Ative V", "Habilite V", "Permita V", "É preciso ativar V"], ["para ver o conteúdo", "no seu navegador", "e recarregue", "para continuar"], ["Este site precisa de JavaScript", "O aplicativo não funciona sem V", "JavaScript está desligado", "Seu navegador é antigo demais", "É necessário JavaScript"]),
    "ja": (["JavaScript", "スクリプト"], ["Vを有効にしてください", "Vをオンにしてください", "Vを許可してください"], [""], ["このサイトにはVが必要です", "Vが無効になっています", "お使いのブラウザには対応していません", "Vを使わないと表示できません"]),
}
WAIT = {
    "en": ["Loading", "Loading content", "Loading page", "Loading application", "Please wait", "One moment please", "Just a second", "Fetching data", "Preparing the page", "The content is loading", "Loading the document", "Please be patient while the data loads", "Initialising", "Starting the application", "Redirecting", "You will be redirected shortly", "Still loading, hang on", "Rendering"],
    "de": ["Laden", "Bitte warten", "Einen Moment bitte", "Inhalt wird geladen", "Daten werden abgerufen", "Sie werden weitergeleitet"],
    "fr": ["Chargement", "Veuillez patienter", "Un instant", "Chargement des données", "Vous allez être redirigé"],
    "es": ["Cargando datos", "Espere un momento", "Un instante por favor", "El contenido se está cargando", "Será redirigido"],
    "pt": ["Carregando dados", "Aguarde um momento", "Só um instante", "O conteúdo está sendo carregado", "Você será redirecionado"],
    "ja": ["ロード中", "しばらくお待ちください", "データを取得しています", "ページを準備しています"],
}
CHECKS = ["Checking your connection", "Making sure you are not a robot", "Complete the captcha to proceed", "Unusual traffic was detected from your network", "Security check in progress", "Prove that you are a person", "This request was blocked by our firewall", "Too many requests from your address", "Rate limit exceeded", "You are sending requests too quickly", "Your quota is used up, wait N seconds", "Request number H", "Incident H", "Error reference H", "Slow down", "Please retry after N seconds"]
TRACES = ["Traceback (most recent call last):", 'File "/app/P.py", line N, in P', "P.PException: P is null", "PError: name 'P' is not defined", "PError: cannot read property 'P' of undefined", "ValueError: invalid literal for int() with base 10: 'P'", "at com.P.P.run(P.java:N)", "Fatal error: Uncaught Error: Call to undefined function P() in /var/www/P.php on line N", "Notice: Undefined index: P in /var/www/html/P.php on line N", "Warning: include(P.php): failed to open stream in /home/P/index.php on line N", "Parse error: syntax error, unexpected end of file in /var/www/P.php on line N", "Deprecated: Function P() is deprecated in /usr/share/P.php on line N", "Stack trace:", "#0 {main}", "SQLSTATE[HY000]: General error: N", "connect ECONNREFUSED 127.0.0.1:N", "Connection refused (port N)", "Segmentation fault (core dumped)", "Out of memory", "Unhandled exception in P", "panic: runtime error: index out of range", "Cannot connect to the database on port N", "Template P not found", "Missing translation: P", "Exception in thread main", "Error: module P not found", "Status code N", "Error code: P_P"]
LOREM = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
BLANKS = {
    "en": (["text", "title", "heading", "headline", "paragraph", "caption", "description", "summary", "content", "copy", "name", "subtitle", "article", "section"], ["Your V", "Your V here", "Your V goes here", "Some V here", "Sample V", "Dummy V", "Default V", "Example V", "V placeholder", "V will appear here", "V to follow", "V to be added", "V pending", "Insert V", "Insert your V here", "Enter a V", "Type your V", "Add a V", "Add a short V in a few lines", "Write a V of the product here", "Put the V here", "Click here to edit the V", "Replace this V", "This V is only here to fill the page", "This is where the V goes", "Short V of your company", "V to come from the marketing team", "Double-click to change the V", "Lorem V"]),
    "de": (["Text", "Titel", "Beschreibung", "Inhalt", "Überschrift"], ["Ihr V", "Hier Ihr V", "V folgt", "V einfügen", "Muster-V", "V hier eingeben", "Dieser V wird noch geschrieben", "Das ist nur ein V zum Auffüllen", "Platz für V", "Blindtext", "Hier steht bald ein V", "Hier kommt der V hin"]),
    "fr": (["texte", "titre", "contenu", "résumé", "paragraphe"], ["Votre V", "Votre V ici", "V à venir", "Insérez le V", "V d'essai", "Saisissez un V ici", "Ce V est à remplacer", "Faux V pour remplir la page"]),
    "es": (["texto", "título", "contenido", "resumen", "párrafo"], ["Su V", "Su V aquí", "V por escribir", "Inserte el V", "V de prueba", "Escriba un V aquí", "Este V se debe cambiar", "V de muestra para llenar la página"]),
    "pt": (["texto", "título", "conteúdo", "resumo", "parágrafo"], ["Seu V", "Seu V aqui", "V a definir", "Insira o V", "V de teste", "Digite um V aqui", "Este V deve ser trocado", "V de amostra para encher a página"]),
    "ja": (["文章", "本文", "見出し", "説明", "テキスト"], ["Vを入力してください", "ここにVを書きます", "Vは準備中です", "仮のVです", "ダミーのV"]),
}
UNWRITTEN = ["Coming soon", "Under construction", "Work in progress", "To be announced", "To be decided", "To be completed", "To be done", "TODO", "TBD", "TBA", "FIXME", "TODO: describe V", "TODO add the V", "TBD by the V team", "This page is empty", "This page was left blank on purpose", "No content yet", "Nothing here yet", "Not written yet", "Draft, do not publish", "Untitled", "Untitled page", "New page", "My first page", "Hello world", "undefined", "null", "None", "NaN", "[object Object]", "undefined null undefined", "n/a", "Demnächst", "Im Aufbau", "Bientôt disponible", "En construction", "Próximamente", "En construcción", "Em breve", "Em construção", "準備中", "工事中"]
KEYS = ["asdf", "jkl", "qwer", "zxcv", "hjkl", "sdfg", "uiop", "fdsa", "blah", "bla", "test", "testing", "foo", "bar", "baz", "xxx", "xxxx", "xx", "yyy", "zzz", "aaa", "abc", "123", "dummy", "ignore"]
# Syntaxes of unfilled placeholders around a name N.
FORMS = ["{{N}}", "{{ N }}", "${N}", "#{N}", "<%= N %>", "{% block N %}", "{% N %}", "[[N]]", "((N))", "%%N%%", "@@N@@", "__N__", "$N$", "{N}", "<N>", "&lt;N&gt;", "[N goes here]", "[insert N]", "TBD: N text", "TODO: N", "%(N)s", "{{{N}}}", "[% N %]", "<<N>>", "[Your N]"]
NAMES = "title name heading summary body author date version company product_name page.title page.author user.name section_name intro first_name email site.url item".split()
AROUND = ["# %s", "## About %s", "Dear %s, thank you", "%s", "Written for %s", "%s and its parts", "Release %s", "Every %s has a list of entries", "The archive of %s opens at once"]


def _lang(r: random.Random) -> str:
    return r.choices(["en", "de", "fr", "es", "pt", "ja"], [8, 2, 2, 2, 2, 2])[0]


def _end(r: random.Random, s: str, lang: str) -> str:
    return s + ("。" if lang == "ja" else r.choice([".", ".", "", "!", "..."]))


def _numbers(r: random.Random, s: str) -> str:
    out = []
    for w in s.split(" "):
        core = w.strip(".,;:!()'")
        out.append(w.replace("N", str(r.randint(2, 999))) if core == "N" else w.replace("H", f"{r.getrandbits(40):010x}") if core == "H" else w)
    return " ".join(out)


def _code(r: random.Random) -> str:
    lang = _lang(r)
    if lang in REASONS:
        s = r.choice(REASONS[lang])
        glue = "" if lang == "ja" else " "
        return _end(r, s, lang) if r.random() < 0.6 else _end(r, s, lang) + glue + _numbers(r, _end(r, r.choice((LOST if r.random() < 0.5 else BROKEN)[lang][2]), lang))
    s = r.choice([s for s in HTTPStatus if s >= 400])
    form = r.choice(["{n} {p}", "{n}", "{p}", "Error {n}", "HTTP {n}", "HTTP error {n} - {p}", "{n} – {p}", "{n}: {p}", "Error {n}: {p}", "{p} ({n})"])
    return form.format(n=int(s), p=s.phrase)


def _said(parts: dict, r: random.Random) -> str:
    lang = _lang(r)
    who, what, advice = parts[lang]
    glue = "" if lang == "ja" else " "
    u = r.random()
    first = _end(r, r.choice(who) + glue + r.choice(what), lang)
    if u < 0.5:
        return first
    return first + glue + _end(r, r.choice(advice), lang) if u < 0.8 else _end(r, r.choice(advice), lang)


def _trace(r: random.Random, parts: list[str] = TRACES) -> str:
    word = lambda m: r.choice(["Page", "Render", "View", "Config", "Loader", "body", "user", "main", "index", "Node", "cache"])
    s = re.sub(r"P(?=[^a-z]|Error|Exception|$)", word, r.choice(parts))
    return re.sub(r"\bN\b", lambda m: str(r.randint(2, 9999)), s)


def _script(r: random.Random) -> str:
    lang = _lang(r)
    nouns, asks, tails, states = SCRIPTS[lang]
    v = r.choice(nouns)
    s = r.choice(asks) + " " + r.choice(tails) if r.random() < 0.55 else r.choice(states)
    s = s.strip().replace("V", v, 1) if "V" in s else s
    return _end(r, s[:1].upper() + s[1:] if s != "noscript" else s, lang)


def _blank(r: random.Random) -> str:
    lang = _lang(r)
    nouns, forms = BLANKS[lang]
    s = r.choice(forms).replace("V", r.choice(nouns))
    s = _end(r, s[:1].upper() + s[1:], lang)
    return " ".join([s] * r.choice([1, 1, 1, 2, 3]))


def _lorem(r: random.Random) -> str:
    w = LOREM[: r.randint(5, 20)] if r.random() < 0.3 else r.choices(LOREM, k=r.randint(5, 30))
    return " ".join(w).capitalize() + "."


def _keys(r: random.Random) -> str:
    few = r.sample(KEYS, r.randint(1, 3))
    return " ".join(r.choices(few, k=r.randint(2, 9)))


def _unwritten(r: random.Random) -> str:
    return r.choice(UNWRITTEN).replace("V", r.choice(BLANKS["en"][0])) + r.choice(["", "", ".", "..."])


def _wait(r: random.Random) -> str:
    return r.choice(WAIT[_lang(r)]) + r.choice(["...", "…", "", ".", "!"])


def _refused(r: random.Random) -> str:
    lang = _lang(r)
    return _end(r, r.choice(REFUSED[lang]), lang)


#: A maker of texts for each kind; the last five are filler, the others error pages and script notices.
FAMILIES = {
    "codes": _code,
    "lost": lambda r: _numbers(r, _said(LOST, r)),
    "broken": lambda r: _numbers(r, _said(BROKEN, r)),
    "standard": lambda r: _trace(r, STANDARD),
    "refused": _refused,
    "scripts": _script,
    "wait": _wait,
    "checks": lambda r: _numbers(r, r.choice(CHECKS)) + r.choice(["", ".", "..."]),
    "traces": _trace,
    "blanks": _blank,
    "lorem": _lorem,
    "keys": _keys,
    "unwritten": _unwritten,
    "mixed": lambda r: _unwritten(r) + " " + _blank(r),
}


def placeholder(r: random.Random) -> str:
    x = r.choice(FORMS).replace("N", r.choice(NAMES))
    return r.choice(AROUND) % (x.upper() if r.random() < 0.3 else x)


def text(r: random.Random, without: tuple[str, ...] = ()) -> str:
    """A text of a kind drawn evenly from those that are not left out."""
    return FAMILIES[r.choice([k for k in FAMILIES if k not in without])](r)
