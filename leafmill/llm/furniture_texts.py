"""Phrases of page furniture in six languages, put together from parts.

The parts are fixed values written from general knowledge of web pages (the
README says how they relate to the test tables): each entry of a group is a row
of slots, a slot a choice of
words parted by ``|``.  S is the site's name, T a page title, N a number, D a
date.
"""

from __future__ import annotations

import random

LANGUAGES = ["en", "de", "fr", "es", "pt", "ja"]

# Parts of the phrases by group and language.
CONTROLS = {
    "en": [["Skip to|Jump to|Go to", "content|main content|the main text|navigation|the search box|footer"], ["Edit|Print|Copy|Share|Download|Report|Improve|Bookmark|Save|Translate|Rate", "this page|page|the page|this article|this guide|link|the address|this document"], ["Open|Close|Show|Hide|Toggle|Expand|Collapse", "menu|the menu|sidebar|the outline|navigation|all sections|dark mode|light theme|full width"], ["View|Open|Show|Get|Save|Download", "as PDF|as plain text|as Markdown|the source|raw|page source on the S repository|history|print version"], ["Search|Search S|Search docs|Search the docs|Find in S|Ask S|Search the S site", "|(press /)|(Ctrl K)|...|…"], ["Edit|Suggest a change|View this file|Open an issue|Found a mistake? Tell us", "on the S repository|on the S forge|in the S tracker|"], ["Report an issue|Report a problem|Send a correction|Suggest an edit", "|with this page|for this article"]],
    "de": [["Zum|Direkt zum", "Inhalt|Hauptinhalt|Menü|Seitenende"], ["Seite|Diese Seite|Artikel|Link|Adresse|Beitrag", "drucken|bearbeiten|kopieren|teilen|melden|merken|als PDF speichern"], ["Menü|Suche|Navigation|Seitenleiste|Übersicht", "öffnen|schließen|ein- und ausblenden|zeigen"], ["Suche|In S suchen|Suchbegriff eingeben|Problem melden|Fehler auf dieser Seite melden|Als PDF laden|Quelltext zeigen"]],
    "fr": [["Aller|Passer|Revenir", "au contenu|au menu|à la recherche|au pied de page"], ["Imprimer|Modifier|Partager|Copier|Signaler|Enregistrer", "|cette page|la page|le lien|l'article|l'adresse"], ["Ouvrir|Fermer|Afficher|Masquer", "le menu|la recherche|la barre latérale|le sommaire"], ["Rechercher|Rechercher dans S|Recherche sur le site S|Signaler un problème|Signaler une erreur|Version imprimable|Voir la source"]],
    "es": [["Saltar|Ir|Volver", "al contenido|al menú|a la búsqueda|al pie"], ["Imprimir|Editar|Compartir|Copiar|Guardar|Descargar", "|esta página|la página|el enlace|el artículo|en PDF"], ["Abrir|Cerrar|Mostrar|Ocultar", "el menú|la búsqueda|la barra lateral|el índice"], ["Buscar en S|Buscar en el sitio|Informar de un error|Informar de un problema|Avisar de un fallo|Ver el código fuente"]],
    "pt": [["Pular|Ir|Voltar", "para o conteúdo|para o menu|para a busca|ao rodapé"], ["Imprimir|Editar|Compartilhar|Copiar|Salvar|Baixar", "|esta página|a página|o link|o artigo|em PDF"], ["Abrir|Fechar|Mostrar|Ocultar", "o menu|a busca|a barra lateral|o sumário"], ["Pesquisar em S|Buscar no site|Informar um erro|Relatar um problema|Avisar de uma falha|Ver o código-fonte"]],
    "ja": [["本文|メニュー|検索|フッター", "へ移動|へスキップ|を開く|を閉じる"], ["このページ|記事|リンク|URL", "を編集|を印刷|をコピー|を共有|を保存|を報告"], ["印刷する|印刷|問題を報告|問題を報告する|検索|サイト内検索|Sを検索|PDFで保存|ソースを表示"]],
}
MENU = {
    "en": "Home|Start|Docs|Documentation|API|Blog|Guides|Tutorials|Reference|Support|Community|Changelog|Releases|Pricing|Plans|Status|Contact|Contact us|About|About us|Login|Log in|Sign in|Sign up|Register|Download|Downloads|Search|Careers|Jobs|News|Products|Solutions|Help|Help center|Account|My account|Forum|Events|Examples|Features|Partners|Press|Team|Store|Learn|Resources|Integrations|FAQ|Shop|Cart",
    "de": "Startseite|Start|Handbuch|Anleitungen|Referenz|Blog|Preise|Hilfe|Kontakt|Anmelden|Registrieren|Suche|Status|Über uns|Produkte|Download|Neuigkeiten|Forum|Team|Karriere|Beispiele|Konto|Shop|Presse|Dokumentation|Lösungen",
    "fr": "Accueil|Manuel|Guides|Référence|Blog|Tarifs|Aide|Contact|Connexion|Inscription|Recherche|Statut|Produits|À propos|Actualités|Forum|Équipe|Exemples|Compte|Presse|Documentation|Téléchargement|Boutique|Emplois",
    "es": "Inicio|Manual|Guías|Referencia|Blog|Precios|Ayuda|Contacto|Entrar|Registro|Buscar|Estado|Productos|Nosotros|Acerca de|Noticias|Foro|Equipo|Ejemplos|Cuenta|Prensa|Documentación|Descargas|Tienda|Empleo",
    "pt": "Início|Manual|Guias|Referência|Blog|Preços|Ajuda|Contato|Entrar|Cadastro|Busca|Estado|Produtos|Sobre nós|Sobre|Notícias|Fórum|Equipe|Exemplos|Conta|Imprensa|Documentação|Downloads|Loja|Carreiras",
    "ja": "ホーム|トップ|文書|ドキュメント|ガイド|参照|ブログ|料金|価格|支援|サポート|ログイン|会員登録|検索|会社案内|製品|ニュース|お問い合わせ|採用|事例|フォーラム|マイページ",
}
CONSENT = {
    "en": [["We use|S uses|This site uses|This website uses|Our partners and we use|We would like to use", "cookies|tracking cookies|cookies and similar tools|small data files|local storage", "to improve your visit.|to measure traffic.|to count visits and remember your choices.|to keep you logged in.|for statistics and ads.|so that the pages of S work well.|to analyse how the site is used."], ["By using|By browsing|If you go on using|When you continue on", "this site|our site|the pages of S|this website", "you agree to our cookie policy.|you accept our terms and the privacy notice.|you consent to the storage of data.|you allow us to place cookies."], ["Your privacy is important to us.|We value your privacy.|We care about your data.|Cookie notice:|About cookies", "|Choose which cookies you allow.|You may change your mind at any time.|Read more in the privacy policy.|Manage your preferences or close this notice.|Pick the trackers that may be set in your browser."], ["This website|This site|S", "remembers your settings|stores your preferences|keeps data on your device", "on this device.|in your browser. Close this banner to agree.|as set out in the privacy policy.|together with its partners."]],
    "de": [["Wir verwenden|S verwendet|Diese Website nutzt|Wir nutzen", "Cookies|kleine Dateien|Cookies und ähnliche Techniken", ", um Besuche zu zählen.|, damit die Seiten gut laufen.|, um Ihre Auswahl zu speichern.|für Statistik und Werbung."], ["Mit der Nutzung|Durch den Besuch|Wenn Sie weiterlesen,", "dieser Seite|der Seiten von S|dieser Website", "stimmen Sie unseren Regeln zum Datenschutz zu.|erklären Sie sich mit Cookies einverstanden.|akzeptieren Sie die Datenschutzhinweise."]],
    "fr": [["Nous utilisons|S utilise|Ce site utilise|Nos partenaires utilisent", "des cookies|des traceurs|des cookies et outils semblables", "pour mesurer l'audience.|pour compter les visites.|pour retenir vos choix.|afin d'améliorer le site S."], ["En continuant,|En naviguant ici,|Si vous restez sur ce site,", "vous acceptez", "nos cookies.|notre politique de confidentialité.|l'enregistrement de vos préférences.|le dépôt de traceurs."], ["S enregistre|Ce site garde", "vos préférences|vos choix", "sur cet appareil.|dans votre navigateur. Vous pouvez les modifier."]],
    "es": [["Usamos|S usa|Este sitio utiliza|Nuestros socios usan", "cookies|cookies propias y de terceros|pequeños archivos", "para contar las visitas.|para medir el tráfico.|para recordar sus opciones.|con fines de análisis."], ["Si continúa,|Al navegar aquí,|Al seguir en este sitio,", "acepta", "nuestras cookies.|la política de privacidad.|el uso de datos.|que guardemos sus preferencias."], ["S guarda|Este sitio guarda", "sus preferencias|sus opciones", "en el dispositivo. Puede modificarlas.|en su navegador."]],
    "pt": [["Usamos|A S usa|Este site utiliza|Nossos parceiros usam", "cookies|cookies próprios e de terceiros|pequenos arquivos", "para contar as visitas.|para medir o tráfego.|para lembrar suas escolhas.|com fins de análise."], ["Se continuar,|Ao navegar aqui,|Ao seguir neste site,", "você aceita", "nossos cookies.|a política de privacidade.|o uso de dados.|que guardemos suas preferências."], ["A S guarda|Este site guarda", "suas preferências|suas escolhas", "no aparelho. Você pode alterá-las.|no seu navegador."]],
    "ja": [["当サイト|S|このサイト|Sのページ", "では|は", "クッキーを使用しています。|アクセス解析のためにクッキーを使用します。|利用状況を測定しています。|設定を端末に保存します。|お客様の選択を記録します。"], ["続けて利用すると|閲覧を続けると", "クッキーの使用に同意したことになります。|個人情報の取り扱いに同意したとみなします。"]],
}
BUTTONS = {
    "en": "Accept all|Accept|Accept cookies|Reject all|Reject|Decline|Allow|Allow all|Allow selection|Deny|Agree|I agree|Got it|OK|Okay|Close|Dismiss|Settings|Cookie settings|Manage choices|Manage preferences|Customise|More options|Only necessary|Essential only|Save choices|Learn more",
    "de": "Alle annehmen|Alle akzeptieren|Annehmen|Akzeptieren|Ablehnen|Zustimmen|Einverstanden|Einstellungen|Auswahl ändern|Auswahl speichern|Nur notwendige|Mehr erfahren|Schließen",
    "fr": "Tout accepter|Accepter|Tout refuser|Refuser|Continuer sans accepter|J'accepte|Gérer mes choix|Paramètres|Personnaliser|Fermer|En savoir plus|Cookies essentiels",
    "es": "Aceptar todo|Aceptar|Rechazar todo|Rechazar|Estoy de acuerdo|Configurar|Configurar cookies|Gestionar opciones|Solo necesarias|Cerrar|Saber más|Guardar",
    "pt": "Aceitar tudo|Aceitar|Recusar tudo|Recusar|Concordo|Definições|Gerenciar opções|Somente necessários|Fechar|Saiba mais|Salvar",
    "ja": "すべて許可|すべて受け入れる|同意する|許可する|拒否する|拒否|設定|詳細|閉じる|必要なもののみ|了解",
}
SIDE = {
    "en": [["On this page|In this article|In this section|In this guide|Contents|Page contents|Table of contents|Quick links|Outline"], ["Related|Similar|Popular|Recent|More|Top|New|Latest|Recommended|Featured|Trending", "pages|articles|guides|topics|posts|links|reading|documents"], ["You may also like|See also in S|More from S|More on S|Also in this chapter|Recently updated|Recently viewed|Most read|Other readers opened|Up next in S|Latest from the S blog"]],
    "de": [["Auf dieser Seite|In diesem Abschnitt|In diesem Bereich|Seiteninhalt|In diesem Kapitel|Schnellzugriff"], ["Verwandte|Ähnliche|Beliebte|Neue|Weitere|Empfohlene", "Themen|Artikel|Seiten|Anleitungen|Beiträge"], ["Mehr von S|Mehr zu S|Zuletzt geändert|Meistgelesen|Das könnte Sie auch interessieren"]],
    "fr": [["Sur cette page|Dans cet article|Dans cette rubrique|Dans cette section|Sommaire de la page"], ["Articles|Pages|Guides|Sujets", "liés|populaires|récents|similaires|recommandés"], ["À lire aussi|Plus sur S|Les plus lus|Vous aimerez aussi"]],
    "es": [["En esta página|En este artículo|En esta sección|En este capítulo|Contenido de la página"], ["Artículos|Páginas|Guías|Temas", "relacionados|populares|recientes|similares|recomendadas|relacionadas"], ["Más de S|Más sobre S|Lo más leído|Le puede interesar"]],
    "pt": [["Nesta página|Neste artigo|Nesta seção|Neste capítulo|Conteúdo da página"], ["Artigos|Páginas|Guias|Temas", "relacionados|populares|recentes|semelhantes|recomendadas|relacionadas"], ["Mais da S|Mais sobre a S|Os mais lidos|Você também pode gostar"]],
    "ja": [["このページの内容|この記事の内容|この章の内容|ページ内の項目|目次"], ["関連|人気の|最近の|おすすめの|新着", "ガイド|記事|ページ|リンク"]],
}
PROMPTS = {
    "en": [["Subscribe to|Sign up for|Join|Get|Receive", "our newsletter|the S newsletter|our mailing list|product updates|S news by mail|our weekly digest|the monthly letter", "|and stay up to date.|and never miss an update of S.|once a month.|Enter your e-mail address.|Join N other readers."], ["Share|Tweet|Send|Forward|Recommend|Pass on", "this page|this article|it|this guide|the link", "with a friend|with your team|by mail|on social media|on your network|: Mail | Chat | Link|: Copy link | E-mail"], ["Was this page|Was this article|Was this guide|Did you find this page|Is this page", "helpful?|useful?|clear?|of use to you?", "|Yes No|Yes  No|Yes | No|Thumbs up  Thumbs down"], ["Did this|Has this page", "answer your question?|solve your problem?", "|Send feedback.|Tell S what is missing.|Give us feedback"], ["Rate this|Rate the", "page|article|guide", ": 1 2 3 4 5|from N to N|★ ★ ★ ★ ★"], ["Still have questions?|Need more help?|Stuck?|Any questions?|Need help?|Can't find it?", "Contact S support.|Ask the community.|Open a ticket.|Write to the S help desk.|Talk to S.|Join the forum."], ["Ask|Discuss|Talk about", "this topic|this guide|S", "in the S forum|in the community forum of S|with other users"], ["Advertisement|Ad|Sponsored|Promoted|Our sponsor", ": try S Cloud free for N days|– S Pro now N percent off|: host your pages with S|– learn S in N days", ""], ["Start|Begin|Claim", "your free trial|a free N day trial", "of S Cloud|of S today|now"], ["Follow|Like|Find", "S|us", "on social media|on the usual networks|on our channels"], ["N", "people|readers|users|colleagues|visitors", "liked this page|shared this article|found this helpful|recommend this guide|bookmarked this page|rated this article"], ["Liked this page?|Enjoyed the guide?|Do you like S?|Love S?", "Share it.|Tell a friend about S.|Star us.|Recommend it to your team."], ["Leave a comment|Write a comment|Be the first to comment|Add your comment|Log in to comment"]],
    "de": [["Newsletter|Den Rundbrief von S|Unsere Neuigkeiten", "abonnieren|bestellen|erhalten", "|und keine Neuigkeit verpassen|und auf dem Laufenden bleiben"], ["Diesen Beitrag|Diese Seite|Den Artikel", "teilen|empfehlen|weiterleiten", "|: Mail | Link|: Chat | Mail|mit Kollegen"], ["War|Ist", "diese Seite|der Artikel", "hilfreich?|nützlich?", "|Ja Nein|Ja  Nein|Ja | Nein"], ["Fragen?|Noch Fragen?|Brauchen Sie Hilfe?", "Schreiben Sie uns.|Wenden Sie sich an S.|Fragen Sie den Support von S.|Zum Forum."], ["Anzeige|Werbung", ": S Cloud jetzt testen|: N Tage S kostenlos|– S Pro mit N Prozent Rabatt"], ["Gefällt Ihnen|Mögen Sie", "die Seite?|S?|der Artikel?", "Empfehlen Sie uns.|Teilen Sie sie.|Erzählen Sie es weiter."]],
    "fr": [["Abonnez-vous|Inscrivez-vous", "à notre lettre|à l'infolettre de S|à la lettre d'information", "|pour ne rien manquer"], ["Recevez", "la lettre de S|nos nouvelles|les nouveautés de S", "par courriel|chaque mois"], ["Partager|Envoyer", "cet article|cette page", "|: courriel | lien|: message | lien|à un collègue"], ["Cette page|Cet article", "vous a-t-elle aidé ?|est-elle utile ?|a-t-il répondu à vos questions ?", "|Oui Non|Oui  Non|Oui | Non"], ["Une question ?|Besoin d'aide ?|Des questions ?", "Écrivez-nous.|Contactez S.|Écrivez au support de S.|Voir le forum."], ["Publicité|Annonce", ": essayez S Cloud|: S gratuit pendant N jours|– S Pro à N pour cent"], ["Vous aimez", "cette page ?|S ?", "Parlez-en.|Partagez-la.|Recommandez-nous."]],
    "es": [["Suscríbase|Apúntese", "al boletín|al boletín de S|a nuestras noticias", "|y no se pierda nada"], ["Reciba", "el boletín|las novedades de S", "por correo|cada mes"], ["Comparta|Envíe", "este artículo|esta página", "|: correo | enlace|: mensaje | enlace|con su equipo"], ["¿Le ayudó|¿Le resultó útil|¿Fue útil", "esta página?|este artículo?", "|Sí No|Sí  No|Sí | No"], ["¿Dudas?|¿Preguntas?|¿Necesita ayuda?", "Escriba a S.|Contacte con soporte.|Escriba al equipo de S.|Visite el foro."], ["Publicidad|Anuncio", ": pruebe S Cloud|: S gratis N días|– S Pro con N por ciento menos"], ["¿Le gusta", "la página?|S?|este artículo?", "Recomiéndela.|Compártala.|Hable de S."]],
    "pt": [["Assine|Receba", "o boletim|o boletim da S|nossa lista|as novidades da S", "|por e-mail|e não perca nada"], ["Compartilhe|Envie", "este artigo|esta página", "|: e-mail | link|: mensagem | link|com a equipe"], ["Esta página|Este artigo", "foi útil?|ajudou?|respondeu à sua dúvida?", "|Sim Não|Sim  Não|Sim | Não"], ["Dúvidas?|Perguntas?|Precisa de ajuda?", "Escreva para a S.|Fale conosco.|Fale com a equipe da S.|Visite o fórum."], ["Publicidade|Anúncio", ": experimente a S Cloud|: S grátis por N dias|– S Pro com N por cento a menos"], ["Gostou", "da página?|da S?|do artigo?", "Recomende.|Compartilhe.|Fale da S."]],
    "ja": [["Sの|当社の|最新の", "ニュースレター|メールマガジン|お知らせ", "に登録する|を受け取る|を購読する"], ["このページ|この記事", "を共有する|を同僚に送る|を友人に知らせる"], ["このページ|この記事", "は役に立ちましたか|は参考になりましたか", "|はい いいえ|  はい  いいえ"], ["広告|PR", "：S Cloudを試す|：N日間無料|：Sの新しいプラン"], ["ご質問|お問い合わせ|ご不明な点", "はSまで|はサポートへ|は窓口へご連絡ください"]],
}
BYLINE = {
    "en": [["Published|Posted|Written|Last updated|Updated|Last modified|Reviewed|Last reviewed", "D|on D", "|by S|by the S team|by the S writers|by S staff", "|· N min read| | N minutes to read|– reading time N minutes"], ["By|Written by|Posted by|Reviewed by|From", "the S team|S staff|the editors of S|S writers|the S desk|the documentation group of S", "– D|, D|· D|| D | N min read|on D"], ["S", "Editorial|Learning team|Docs|Press|Newsroom|Desk", ", D|– D|· D"]],
    "de": [["Veröffentlicht|Verfasst|Zuletzt geändert|Aktualisiert|Stand|Geprüft", ": D|am D", "|von S|von der Redaktion|vom Team S", "|· N Min. Lesezeit|· Lesezeit N Minuten"], ["Von der Redaktion|Vom Team", "S", "– D|am D"]],
    "fr": [["Publié|Rédigé|Mis à jour|Relu|Modifié", "le D", "|par S|par l'équipe S", "|· N min de lecture|· lecture N minutes"], ["Par|Écrit par", "l'équipe S|la rédaction de S", "le D|– D"]],
    "es": [["Publicado|Escrito|Actualizado|Revisado|Modificado", "el D", "|por S|por el equipo S", "|· N min de lectura|· lectura de N minutos"], ["Por|Escrito por", "el equipo de S|la redacción de S", "el D|– D"]],
    "pt": [["Publicado|Escrito|Atualizado|Revisado|Modificado", "em D", "|por S|pela equipe S", "|· N min de leitura|· leitura de N minutos"], ["Por|Escrito por", "equipe S|redação da S", "em D|– D"]],
    "ja": [["最終更新|更新日|公開日|掲載", " D|:D|：D", "|(読了N分)| · 読了N分"], ["S編集部|Sチーム|S", "がDに公開|がDに更新", "|しました|しました(読了N分)"]],
}
STEPS = {
    "en": ["← Previous: T", "Next: T →", "Previous: T", "Next: T", "‹ T", "T ›", "« T | T »", "Previous | Next", "Up next – T", "Up next: T", "← T", "T →", "Continue with T", "Back to T", "Previous page", "Next page"],
    "de": ["← Zurück: T", "Weiter: T →", "Zurück: T", "Weiter: T", "« T | T »", "← T", "T →", "Nächste Seite", "Vorige Seite"],
    "fr": ["← Précédent : T", "Suivant : T →", "Précédent : T", "Suivant : T", "« T | T »", "← T", "T →", "Page suivante"],
    "es": ["← Anterior: T", "Siguiente: T →", "Anterior: T", "Siguiente: T", "« T | T »", "← T", "T →", "Página siguiente"],
    "pt": ["← Anterior: T", "Próximo: T →", "Anterior: T", "Próximo: T", "« T | T »", "← T", "T →", "Próxima página"],
    "ja": ["← 前へ: T", "次へ: T →", "前へ: T", "次へ: T", "« T | T »", "次のページ", "前のページ"],
}
_LEGAL = {
    "en": "Terms|Terms of use|Terms of service|Privacy|Privacy policy|Cookies|Cookie policy|Imprint|Legal|Legal notice|Accessibility|Security|Sitemap|Licence|Trademarks|Contact|Disclaimer",
    "de": "Impressum|Datenschutz|Nutzungsbedingungen|AGB|Barrierefreiheit|Kontakt|Rechtliches|Übersicht",
    "fr": "Mentions légales|Confidentialité|Plan du site|Conditions|Cookies|Accessibilité|Contact",
    "es": "Aviso legal|Privacidad|Mapa del sitio|Condiciones|Cookies|Accesibilidad|Contacto",
    "pt": "Termos|Privacidade|Mapa do site|Aviso legal|Cookies|Acessibilidade|Contato",
    "ja": "利用規約|個人情報保護方針|会社案内|プライバシー|サイトマップ|お問い合わせ|特定商取引法",
}
FOOTER = {
    "en": [["©|Copyright|Copyright ©|(c)", "N|N–N", "S|S Ltd.|S Inc.|S and contributors|the S authors|S Foundation", "|. All rights reserved.|All rights reserved.|. Licensed under the site licence.|. Some rights reserved."], ["S is|S and its logo are|The S name is", "a trademark|a registered mark|trademarks", "of S Holding.|of their owners.|of S Ltd. Other marks belong to others."], ["Made|Built|Powered|Hosted|Generated|Published", "with love by S|with S|by S|on S Cloud|on D by S|by the S engine. Build N.N|with care in the open"], ["The contents|All content|The information|Everything on this site|Material on these pages", "may not be copied|is given without warranty|is provided for information only|must not be reused", "without permission.|of any kind.|without the consent of S.|and may change."], ["Back to top|Return to top|To the top|Top|Scroll to top"], ["English | Deutsch | Français|English|Language: English|English | Español | 日本語|Deutsch | English"]],
    "de": [["©|Copyright ©", "N", "S|S GmbH|S AG", "|. Alle Rechte vorbehalten.|Alle Rechte vorbehalten."], ["Alle Angaben|Die Inhalte|Die Texte", "ohne Gewähr.|sind urheberrechtlich geschützt.|ohne Gewähr auf Vollständigkeit."], ["Nach oben|Zum Seitenanfang|Seitenanfang|Erstellt mit S|Betrieben von S|Deutsch | English"]],
    "fr": [["©|Copyright ©", "N", "S|S SARL|S SA", "|. Tous droits réservés.|Tous droits réservés."], ["Les contenus|Les informations|Ces textes", "sont fournis sans garantie.|sont protégés.|ne sont donnés qu'à titre indicatif."], ["Haut de page|Retour en haut|Réalisé avec S|Hébergé par S|Français | English"]],
    "es": [["©|Copyright ©", "N", "S|S SL|S SA", "|. Todos los derechos reservados.|Todos los derechos reservados."], ["Los contenidos|La información|Estos textos", "se ofrece sin garantía.|están protegidos.|tienen solo fines informativos."], ["Volver arriba|Arriba|Hecho con S|Alojado por S|Español | English"]],
    "pt": [["©|Copyright ©", "N", "S|S Ltda.|S SA", "|. Todos os direitos reservados.|Todos os direitos reservados."], ["Os conteúdos|As informações|Estes textos", "são dados sem garantia.|estão protegidos.|têm apenas fins informativos."], ["Voltar ao topo|Topo|Feito com S|Hospedado por S|Português | English"]],
    "ja": [["©|Copyright ©", "N", "S|株式会社S", "|無断転載を禁じます|すべての権利を保有します"], ["掲載内容|当サイトの情報|このサイトの内容", "は無保証です|の転載を禁じます|は予告なく変わることがあります"], ["先頭へ戻る|ページの先頭へ|上へ戻る|日本語 | English"]],
}
GROUPS = {"controls": CONTROLS, "menu": MENU, "consent": CONSENT, "buttons": BUTTONS, "side": SIDE, "prompts": PROMPTS, "byline": BYLINE, "steps": STEPS, "footer": FOOTER}


def _row(r: random.Random, row: list[str], lang: str) -> str:
    parts = [p for p in (r.choice(_slot(slot)) for slot in row) if p]
    out = ""
    for p in parts:
        glue = "" if lang == "ja" or not out or p[:1] in ",:.：" else " "
        out += glue + p
    return out


def _slot(slot: str) -> list[str]:
    """The words of a slot; `` | `` within words is kept."""
    return [w.replace("\0", " | ") for w in slot.replace(" | ", "\0").split("|")]


def phrase(r: random.Random, group: str, lang: str) -> str:
    """A phrase of a group with its marks S, T, N and D still in it."""
    got = GROUPS[group][lang]
    if isinstance(got, str):
        words = got.split("|")
        if group == "buttons" and r.random() < 0.35:
            return r.choice([" | ", "  ", " "]).join(r.sample(words, r.randint(2, 3)))
        return r.choice(words)
    if group == "footer" and r.random() < 0.25:
        return r.choice([" | ", " · ", "  "]).join(r.sample(_LEGAL[lang].split("|"), r.randint(1, 4)))
    one = r.choice(got)
    return one if isinstance(one, str) else _row(r, one, lang)
