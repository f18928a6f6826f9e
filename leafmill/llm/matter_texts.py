"""Titles and sentences of page matter in six languages, put together from parts.

The parts are fixed values written for this purpose: nouns, verbs and frames in
which N is a noun, V a verb, A an adjective or adverb, W an invented word, S
the site's name and D a number.
"""

from __future__ import annotations

import random

# Fixed values.
NOUNS = {
    "en": "account address alarm answer battery binding bracket branch button cable camera capacity cell channel circuit client clock cluster code column command compiler component contract controller copy counter course cover crate customer cycle database deadline delivery device diagram disk document door driver editor engine entry error event example exercise factor field file filter folder form formula frame function garden group guide handle header hinge house image index input instruction invoice item journal key kitchen label layer lesson letter level library licence light line list machine map margin material measure member memory message meter method model module motor network node note number object offer office option order output package page paper parameter part password patient path pattern payment pipe plan plate point policy port price printer process product program project protocol pump query question queue range record region release report request result review road role room rule sample scale schedule schema school screen script section sensor server service session setting shelf shop signal size source stage station step storage student style surface switch symbol system table target task team template test text theme thread ticket time token tool topic tree type unit update user value valve vehicle version video view volume wall water wheel window worker year zone".split(),
    "de": "Anlage Antwort Arbeiter Aufgabe Auftrag Ausgabe Beispiel Bericht Bild Blatt Buch Datei Datenbank Dienst Drucker Ebene Eingabe Eintrag Ergebnis Fehler Feld Fenster Filter Frage Gerät Gruppe Haus Index Kabel Karte Knoten Konto Kunde Lager Leitung Liste Maschine Menge Meldung Modell Modul Motor Nachricht Netz Nutzer Ordner Paket Plan Preis Projekt Prozess Pumpe Punkt Rechner Regel Reihe Schalter Schlüssel Schritt Seite Server Sitzung Spalte Speicher Stufe Tabelle Text Thema Uhr Vertrag Wand Wasser Wert Zeile Zeit Zelle Ziel".split(),
    "fr": "adresse appareil base bouton câble caisse champ chapitre clé client code colonne commande compte contrat copie cours date disque dossier écran élément entrée erreur étape exemple fenêtre fichier filtre fonction groupe heure image index journal lettre ligne liste livre machine message mesure modèle module moteur niveau note objet option ordre outil page panneau paquet partie plan point pompe porte prix programme projet question rapport règle requête réseau résultat section serveur session signal source système table tâche texte titre tuyau usine valeur version zone".split(),
    "es": "aparato archivo base bomba botón cable caja campo capítulo carpeta cliente clave código columna copia cuenta curso dato disco documento ejemplo elemento entrada error etapa fecha fila filtro fuente función grupo hora imagen índice informe lección línea libro lista llave mapa máquina medida mensaje modelo módulo motor nivel nodo nota número objeto opción orden página panel paquete parte plan precio proceso proyecto puerta punto red regla registro resultado sección servidor sesión sistema tabla tarea texto tiempo título usuario valor ventana versión zona".split(),
    "pt": "aparelho aplicativo arquivo aviso base bomba botão cabo caixa campo capítulo chave cliente código coluna conta cópia curso dado disco documento elemento entrada erro etapa exemplo fila filtro fonte função grupo hora imagem índice item janela lição linha lista livro máquina mapa medida mensagem modelo módulo motor nível nó nota número objeto opção ordem página painel pacote parte plano porta preço processo projeto ponto rede registro regra relatório resultado seção servidor sessão sistema tabela tarefa texto tempo título usuário valor versão zona".split(),
    "ja": "文書 画面 設定 機能 装置 部品 記録 表 行 列 値 鍵 接続 利用者 項目 手順 例 規則 画像 通知 一覧 時間 結果 処理 資料 条件 番号 名前 範囲 場所".split(),
}
VERBS = {
    "en": "adds blocks builds calls carries changes checks cleans closes collects connects contains controls converts copies counts covers creates cuts defines deletes describes displays divides draws drives drops edits ends enters explains fills finds follows gives groups holds includes joins keeps leads leaves limits lists loads locks makes marks measures merges moves names needs offers opens orders pairs parses passes places plans prints protects pulls pushes reads receives records reduces removes renames repeats replaces reports requests resets returns runs saves scans selects sends serves sets shares shows skips sorts splits starts stops stores supports takes tests tracks trains turns updates uses validates waits warns watches works writes".split(),
    "de": "öffnet schließt liest schreibt prüft zählt sammelt ordnet teilt löscht meldet ersetzt hält sendet empfängt speichert lädt druckt zeigt nennt füllt misst startet beendet verbindet trennt kopiert ändert braucht findet erzeugt sperrt verschiebt behält liefert nutzt schützt sortiert".split(),
    "fr": "ouvre ferme lit écrit vérifie compte rassemble trie partage supprime signale remplace garde envoie reçoit charge imprime affiche nomme remplit mesure lance termine relie sépare copie change demande trouve crée bloque déplace fournit utilise protège contient suit".split(),
    "es": "abre cierra lee escribe revisa cuenta reúne ordena divide borra avisa sustituye guarda envía recibe carga imprime muestra nombra llena mide inicia termina conecta separa copia cambia necesita encuentra crea bloquea mueve ofrece usa protege contiene sigue".split(),
    "pt": "abre fecha lê escreve confere conta reúne ordena divide apaga avisa substitui guarda envia recebe carrega imprime mostra nomeia enche mede inicia termina liga separa copia muda precisa encontra cria bloqueia move oferece usa protege contém segue".split(),
    "ja": "開きます 閉じます 読みます 保存します 確認します 数えます 並べます 分けます 消します 送ります 受け取ります 表示します 測ります 始めます 終わります 変えます 作ります 使います".split(),
}
WORDS = {
    "en": "small large new old public hidden slow fast local remote empty full common rare daily whole second third main own other single simple complex early late short long open closed stable".split(),
    "de": "direkt später selten immer langsam schnell einmal zuerst danach genau leise gemeinsam".split(),
    "fr": "vite lentement souvent toujours rarement ensuite directement seulement encore ensemble".split(),
    "es": "pronto despacio siempre a menudo rara vez después directamente solo otra vez juntos".split(),
    "pt": "logo devagar sempre muitas vezes raramente depois diretamente apenas outra vez juntos".split(),
    "ja": "すぐに ゆっくり 常に 一度 直接 先に 後で".split(),
}
TITLES = {
    "en": ["W", "About W", "Set up W", "Using W with Ns", "How W V a N", "The A N in W", "W and the N", "Ns of W", "Why the N matters", "Choosing a N", "Work with Ns", "A N for W", "What W does", "Overview", "Notes", "Example", "See also", "Errors", "Parameters", "Requirements", "Next steps", "Installation", "Introduction", "Troubleshooting", "Limits", "Reference of W", "N and N"],
    "de": ["W", "Über W", "W einstellen", "N und N", "W und N", "Wie W die N V", "N in W", "Was W V", "Überblick", "Hinweise", "Beispiel", "Siehe auch", "Fehler", "Voraussetzungen", "Grenzen von W", "N für W"],
    "fr": ["W", "À propos de W", "Régler W", "N et N", "W et N", "Comment W V", "N dans W", "Ce que fait W", "Aperçu", "Notes", "Exemple", "Voir aussi", "Erreurs", "Prérequis", "Limites de W", "N pour W"],
    "es": ["W", "Acerca de W", "Ajustar W", "N y N", "W y N", "Cómo W V", "N en W", "Qué hace W", "Resumen", "Notas", "Ejemplo", "Véase también", "Errores", "Requisitos", "Límites de W", "N para W"],
    "pt": ["W", "Sobre W", "Ajustar W", "N e N", "W e N", "Como W V", "N em W", "O que W faz", "Resumo", "Notas", "Exemplo", "Veja também", "Erros", "Requisitos", "Limites de W", "N para W"],
    "ja": ["W", "Wについて", "WのN", "NとN", "WとN", "Wの使い方", "概要", "注意", "例", "関連項目", "Nの一覧", "NをVW"],
}
FRAMES = {
    "en": ["The N V the N.", "The A N V each N, and the N V it later.", "If a N V the N, the A N V nothing.", "When W V a N, every A N stays where it is.", "You can V the N by hand; W V it for you.", "Each N has its own N, so a A N never V the other Ns.", "After D minutes the N V all Ns and W V the N.", "Use the A N for Ns that S V once a day.", "This page explains how the N V a N and why the N V first.", "Before the N V, check that the A Ns are there.", "There are D Ns in the N, most of them A.", "W is a N that V Ns in a A way, which helps where the N is A.", "To change the N, open the A N and pick another N.", "Nobody needs the A N until the N V the Ns.", "We suggest a A N, because the Ns of W are often A.", "The N of D Ns is enough for most Ns.", "It V the Ns in order, then V what is left.", "For instance, a A N with D Ns V about one N.", "Note that W V only those Ns which the N has seen.", "In this case the N V an error and the Ns remain A."],
    "de": ["Der N V die N.", "Die N V A den N, und W V ihn danach.", "Wenn eine N den N V, bleibt die N erhalten.", "Sobald W die N V, ist der N A zu finden.", "Jede N hat ihren N, damit W die anderen nicht V.", "Nach D Minuten V der N alle N.", "Diese Seite zeigt, wie W einen N V.", "Es gibt D N, von denen S eine A V.", "Nicht jeder N V die N, doch W tut es A.", "Für die N genügt ein N, den man A prüft."],
    "fr": ["Le N V la N.", "La N V A le N, puis W le V.", "Si une N V le N, la N reste en place.", "Quand W V la N, le N est A disponible.", "Chaque N a son N, et W ne V pas les autres.", "Au bout de D minutes, le N V toutes les N.", "Cette page montre comment W V un N.", "Il y a D N, dont S V A une partie.", "Pour changer le N, il suffit de choisir une autre N."],
    "es": ["El N V la N.", "La N V A el N, y W lo V después.", "Si una N V el N, la N queda en su sitio.", "Cuando W V la N, el N está A disponible.", "Cada N tiene su N, y W no V las demás.", "Al cabo de D minutos, el N V todas las N.", "Esta página explica cómo W V un N.", "Hay D N, de las que S V A una parte.", "Para cambiar el N, basta con elegir otra N."],
    "pt": ["O N V a N.", "A N V A o N, e W o V depois.", "Se uma N V o N, a N fica no lugar.", "Quando W V a N, o N está A disponível.", "Cada N tem seu N, e W não V as outras.", "Ao fim de D minutos, o N V todas as N.", "Esta página explica como W V um N.", "Há D N, das quais S V A uma parte.", "Para mudar o N, basta escolher outra N."],
    "ja": ["NはNをV。", "まずNを確認し、次にWがNをV。", "Nがないときは、WがAV。", "D分後にSはNをV。", "このページでは、WがNをどう扱うかを説明します。", "NとNを分けておくと、NをAV。"],
}


def _fill(r: random.Random, frame: str, lang: str, word, site: str) -> str:
    out = []
    for i, ch in enumerate(frame):
        before, after = frame[i - 1] if i else " ", frame[i + 1] if i + 1 < len(frame) else " "
        alone = not (before.isascii() and before.isalnum()) and not (after.isascii() and after.isalnum() and after != "s")
        if ch in "NVAWSD" and alone:
            v = {"N": lambda: r.choice(NOUNS[lang]), "V": lambda: r.choice(VERBS[lang]), "A": lambda: r.choice(WORDS[lang]), "W": word, "S": lambda: site, "D": lambda: str(r.randint(2, 99))}[ch]()
            out.append(v)
        else:
            out.append(ch)
    s = "".join(out)
    return s[:1].upper() + s[1:]


def sentence(r: random.Random, lang: str, word, site: str) -> str:
    return _fill(r, r.choice(FRAMES[lang]), lang, word, site)


def title(r: random.Random, lang: str, word, site: str) -> str:
    return _fill(r, r.choice(TITLES[lang]), lang, word, site)
