"""Notices as public sites, servers, browsers and frameworks word them, and sentences that only
speak about such notices.  Held out: written before the phrase lists and not used to extend them."""

NOTICES = {
    "en": """404 Not Found
The requested URL was not found on this server.
500 Internal Server Error
The server encountered an internal error and was unable to complete your request.
502 Bad Gateway
503 Service Temporarily Unavailable
504 Gateway Time-out
403 Forbidden
You don't have permission to access this resource.
This page isn't working
This site can't be reached
We couldn't find that page
Sorry, this page isn't available.
Oops! Something went wrong. Please try again later.
You need to enable JavaScript to run this app.
JavaScript appears to be disabled in your browser
Please enable JavaScript to continue using this application.
This website requires JavaScript to function properly.
Your browser does not support JavaScript!
Checking your browser before accessing the site.
Please complete the security check to access this website
Please turn JavaScript on and reload the page.
An unexpected error has occurred.
The page you were looking for doesn't exist.
Error establishing a database connection
The connection has timed out
Access denied. You do not have permission to view this page.
Your session has timed out. Please log in again.
Service unavailable due to maintenance. Please check back soon.
We're sorry, but something went wrong.
Sorry, you have been blocked
Too many requests. Please slow down.
Unable to connect to the server.
This content is not available in your region.
Dear {{ first_name }},
Hello %FIRSTNAME%,
[Your Name]
[INSERT TEXT HERE]
<%= user.name %>
${project.version}
Lorem ipsum dolor sit amet
Your text goes here
TODO: add description
Content coming soon
{{ page.title | escape }}
{{customer-name}}""",
    "de": """404 - Seite nicht gefunden
Die angeforderte Seite wurde nicht gefunden.
Diese Seite existiert leider nicht.
Interner Serverfehler
Zugriff verweigert
Sie haben keine Berechtigung, auf diese Seite zuzugreifen.
Die Website ist nicht erreichbar
Es ist ein Fehler aufgetreten. Bitte versuchen Sie es später noch einmal.
Bitte aktivieren Sie JavaScript in Ihrem Browser.
Diese Anwendung benötigt JavaScript.
JavaScript ist in Ihrem Browser deaktiviert.
Ihr Browser unterstützt kein JavaScript.
Ihre Sitzung ist abgelaufen, bitte melden Sie sich erneut an.
Der Dienst ist vorübergehend nicht verfügbar.
Wegen Wartungsarbeiten ist die Seite derzeit nicht verfügbar.
Hoppla, da ist etwas schiefgelaufen!
Verbindung fehlgeschlagen: Zeitüberschreitung
Der Server antwortet nicht.
Diese Seite wurde verschoben oder gelöscht.
Um diese Seite nutzen zu können, muss JavaScript aktiviert sein.
Hier steht Ihr Text
Inhalt folgt in Kürze
Sehr geehrte/r {{anrede}} {{nachname}},
[Hier Text einfügen]""",
    "fr": """Page non trouvée
La page que vous recherchez n'existe pas.
Erreur 500 : erreur interne du serveur
Accès refusé
Vous n'avez pas l'autorisation d'accéder à cette page.
Ce site est inaccessible
Une erreur s'est produite. Veuillez réessayer plus tard.
Oups, quelque chose s'est mal passé.
Veuillez activer JavaScript dans votre navigateur.
JavaScript est désactivé dans votre navigateur.
Ce site nécessite JavaScript pour fonctionner.
Votre navigateur ne prend pas en charge JavaScript.
Votre session a expiré, veuillez vous reconnecter.
Service temporairement indisponible
Le site est en cours de maintenance.
Le serveur ne répond pas.
Cette page a été déplacée ou supprimée.
Le délai de connexion a expiré.
Vous devez activer JavaScript pour utiliser cette application.
Votre texte ici
Contenu à venir
Cher {{ prénom }},
[Insérer le texte ici]""",
    "es": """Página no encontrada
La página que busca no existe.
Error interno del servidor
Acceso denegado
No tiene permiso para acceder a esta página.
No se puede acceder a este sitio web
Se ha producido un error. Inténtelo de nuevo más tarde.
¡Vaya! Algo salió mal.
Por favor, active JavaScript en su navegador.
JavaScript está desactivado en su navegador.
Este sitio requiere JavaScript para funcionar correctamente.
Su navegador no es compatible con JavaScript.
Su sesión ha caducado. Vuelva a iniciar sesión.
Servicio no disponible temporalmente
El sitio está en mantenimiento.
El servidor no responde.
Esta página ha sido movida o eliminada.
Se agotó el tiempo de espera de la conexión.
Necesita habilitar JavaScript para ejecutar esta aplicación.
Su texto aquí
Contenido próximamente
Estimado {{nombre-del-cliente}}:
[Insertar texto aquí]""",
}

SPOKEN_OF = """The crawler logs a 404 whenever a supplier renames one of its product pages.
Our proxy answered with a bad gateway error twice last week, so the nightly import was repeated by hand.
Readers complained that the old site asked them to enable JavaScript before it showed a single figure.
In Django templates, {{ user.name }} is replaced by the name of the visitor.
The placeholder ${version} in the configuration is substituted by the build server.
A page that could not be found is removed from the index after three visits in a row.
The review lists every entry whose abstract still reads "to be completed".
Lorem ipsum has served printers as sample text for centuries, and few of them could read it.
Wenn der Server nicht antwortet, wiederholt das Skript die Abfrage nach zehn Minuten und schreibt eine Zeile ins Protokoll.
Das Feld {{name}} wird beim Versand durch den Namen des Empfängers ersetzt.
Im Labor wurde das zweite Plasmid nicht gefunden, deshalb wiederholten wir die Transformation.
Die Kollegin meldete, dass der Zugriff auf die Datenbank am Montag verweigert wurde.
Le script relance la requête quand le serveur ne répond pas et note l'heure dans un journal.
Le champ {{nom}} du modèle est remplacé par le nom du client lors de l'envoi.
La protéine n'a pas été trouvée dans le second extrait, malgré trois essais.
Selon le guide, une page supprimée doit renvoyer vers la fiche la plus proche.
El equipo repitió la descarga porque el servidor no respondió durante la noche del martes.
El campo {{nombre}} de la plantilla se sustituye por el nombre del cliente.
La proteína no se encontró en el segundo extracto, a pesar de tres ensayos.
El manual explica qué hacer cuando el acceso a la carpeta está denegado para un usuario nuevo.
Use the macro {{gene}} in a template to insert the symbol.
The assay failed because the reader timed out after forty cycles of mixing.""".splitlines()
