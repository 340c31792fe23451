"""What error pages, script notices, fillers and template fields say, in en, de, fr, es.

Written from the wording of web servers, browsers, content systems and frameworks, without case,
accents and punctuation (the form texts are matched in); ``#`` stands for a number and braces for
alternatives.  ``CORE`` phrases carry a message; ``WORDS`` are the words such messages are made of
besides; they count as covered but carry nothing.
"""

# What error pages and script notices say.
CORE = {
    "en": """
{could not|couldn t|cannot|can not|can t} {be found|be loaded|be displayed|be shown|be opened|be reached|be accessed|be processed|be completed|be retrieved|be rendered|be established|be verified|find|load|display|reach|open|connect|process}
{was|were|is|are} not found|not found|no such {page|file|directory|file or directory|entry|record}|{unable to|failed to} {load|connect|find|open|display|process|complete|access|reach|retrieve|fetch|render|resolve|open stream}
{does not|doesn t|do not|no longer} {exist|exists|respond|answer|load}|{did not|didn t} {respond|answer|load|respond in time|answer in time}|{is not|isn t|not} {responding|working|available|reachable|accessible|open to your account|working right now|available right now}|no longer {available|exists|accessible}
{has been|was|have been} {removed|deleted|moved|blocked|locked|disabled|suspended|logged out|signed out}|{is|has} moved {permanently|temporarily}|moved permanently|{is|are|temporarily|currently|service|page|site} {unavailable|overloaded|offline|locked|temporarily unavailable|currently unavailable|down|down for maintenance|under maintenance|inaccessible}
{temporarily|currently|service} unavailable|under maintenance|scheduled maintenance|{refused|rejected|reset|closed} the connection|connection {refused|reset|closed|timed out|failed|error|lost|was reset}|refused to connect|{has|have|request|connection|operation|it} timed out|timed out|gateway {timeout|time out}
internal {server error|error}|server error|bad {gateway|request}|something went wrong|{an|an unexpected|an internal|an unknown} error {occurred|has occurred|was encountered}|unexpected error|unknown error|error establishing|encountered {an error|an internal error|a problem}|returned {an error|an unexpected response|an invalid response}
access {denied|forbidden|is denied|to this page is denied|to this page has been denied}|permission denied|{you do not|you don t} have {permission|access|the permission|the right}|forbidden|unauthorized|not authorized|too many requests|rate limit exceeded|request {failed|failed with status code #|blocked|denied|could not be completed}|error code #
you have been {blocked|logged out|signed out}|your {request|client|access|address} has been {blocked|denied}|session {expired|has expired|timed out|has timed out|is invalid}|{you must|you need to|please|you have to} {log in|sign in|be logged in|login}
checking your browser|verify {you are human|that you are human|you are not a robot|you re not a robot}|{complete|solve} the {captcha|security check|challenge}|{page|website|site|content|document|video|file} {expired|has expired}
{enable|allow|activate|turn on|switch on|permit|unblock} {javascript|java script|js|scripts|scripting|cookies|active content|active scripting}|{turn|switch} {javascript|java script|js|scripts|scripting|cookies|them} {on|back on}
{javascript|java script|js|scripts|scripting|active scripting|cookies} {is|are|appears to be|seems to be|has been} {disabled|turned off|switched off|deactivated|blocked|not enabled|not supported|required|needed|necessary}|{javascript|java script|js|scripts|scripting|cookies} {must|should|needs to|need to|has to|have to} be {enabled|turned on|switched on|activated|allowed}
{requires|needs|need|require|relies on|depends on|does not work without|doesn t work without|works only with} {javascript|java script|js|scripts|scripting|scripts to run|cookies}|{does not|doesn t} support {javascript|java script|js|scripts|scripting|cookies}|{not|isn t} supported by your browser|{use|try} a browser {with javascript|that supports javascript|that runs javascript|that runs js|that runs scripts}|{unsupported|outdated} browser
{disable|turn off|switch off} {the|your} {script blocker|ad blocker|adblocker|blocker}
{this is a|this is} {dummy|placeholder|sample} {text|entry|page|content}|{dummy|placeholder|sample|filler} {text|copy|content}
""",
    "de": """
{nicht|wurde nicht|wurden nicht|konnte nicht|konnten nicht} {gefunden|gefunden werden|geladen|geladen werden|angezeigt werden|geoffnet werden|verarbeitet werden|abgeschlossen werden|hergestellt werden}|{nicht|derzeit nicht|zurzeit nicht|momentan nicht|vorubergehend nicht|leider nicht|nicht mehr} {verfugbar|erreichbar|vorhanden|verfugbar ist|aufrufbar|moglich|freigegeben}
{existiert|existieren} {nicht|leider nicht|nicht mehr}|{gibt es|es gibt diese seite} {nicht|leider nicht|nicht mehr}|{antwortet|reagiert|ladt|funktioniert} {nicht|nicht mehr|derzeit nicht}|{hat nicht|nicht} {geantwortet|reagiert}|ohne antwort|keine antwort|{lasst|lassen} sich nicht {laden|offnen|anzeigen}|kann nicht {geladen|angezeigt|geoffnet|gefunden|erreicht} werden
{wurde|wurden|ist|ist wegen wartung} {entfernt|geloscht|verschoben|verschoben oder geloscht|gesperrt|blockiert|uberlastet|offline|nicht erreichbar|abgelaufen|unterbrochen}|{entfernt|geloscht|gesperrt|blockiert|uberlastet|offline}|{wegen|aufgrund von} {wartung|wartungsarbeiten}|{in|wird} {wartung|gewartet}|wartungsarbeiten
{interner|unerwarteter|unbekannter} {fehler|serverfehler|server fehler}|serverfehler|{ein|ein unerwarteter|es ist ein|es ist ein unerwarteter} fehler ist aufgetreten|{fehler ist|ist ein fehler|ist ein unerwarteter fehler} aufgetreten|etwas {schiefgelaufen|ist schiefgelaufen|schief gelaufen|ist schief gelaufen}|unerwartete antwort|ungultige {anfrage|antwort}
{zugriff|zugang} {verweigert|verboten|nicht erlaubt|gesperrt}|kein {zugriff|zugang}|keine {berechtigung|zugriffsrechte|erlaubnis}|{zeituberschreitung|zeitlimit uberschritten}|verbindung {verweigert|fehlgeschlagen|abgelehnt|unterbrochen|abgebrochen}|{hat die|verweigert die|lehnt die} verbindung {abgelehnt|verweigert|ab}|verweigert die verbindung|zu viele anfragen|fehlgeschlagen
{sitzung|session} {ist abgelaufen|abgelaufen|wurde beendet}|{melden sie sich|bitte melden sie sich|sie mussen sich} {an|erneut an|anmelden}
{aktivieren|erlauben|schalten|aktiviere} {sie|} {javascript|skripte|cookies|aktive inhalte} {ein|}|{javascript|skripte|cookies} {aktivieren|einschalten|erlauben|zulassen}|{javascript|skripte|cookies} {ist|sind} {deaktiviert|ausgeschaltet|abgeschaltet|blockiert|erforderlich|nicht aktiviert}
{ist|sind} {in ihrem browser|im browser} {deaktiviert|ausgeschaltet|nicht aktiviert}|{muss|mussen} {javascript|cookies} {aktiviert|eingeschaltet} sein|{javascript|skripte|cookies} {muss|mussen} {aktiviert|eingeschaltet} {sein|werden}
{benotigt|braucht|erfordert|setzt} {javascript|skripte|cookies}|{unterstutzt|unterstutzen} {kein javascript|keine skripte|javascript nicht|keine cookies}|{nutzen|verwenden} sie einen browser {mit|der} javascript|{deaktivieren|schalten} sie {den|ihren} {skriptblocker|werbeblocker} {aus|}|schalten sie sie {ein|im browser ein}
{platzhaltertext|blindtext|beispieltext|mustertext|fulltext|probetext}|dies ist ein platzhalter
""",
    "fr": """
{est|sont|page|fiche|reste} {introuvable|introuvables|inaccessible|indisponible|indisponibles|bloque|bloquee|verrouille|verrouillee|surcharge|surchargee}|introuvable|indisponible|inaccessible|non {trouvee|trouve|disponible}|n existe {pas|plus}|n est {pas|plus} {disponible|accessible|joignable|ouverte a votre compte|ouvert a votre compte}
{temporairement|momentanement|actuellement} {indisponible|inaccessible}|n a pas {pu etre chargee|pu etre charge|pu etre affichee|pu etre trouvee|repondu|repondu a temps|ete trouvee|ete trouve}|{ne peut pas|ne peut|ne peuvent pas} etre {chargee|charge|affichee|affiche|trouvee|trouve|ouverte|ouvert}|impossible {de charger|d afficher|de joindre|de trouver|d ouvrir|de se connecter|d acceder|d etablir|de contacter}
a ete {supprimee|supprime|retiree|retire|deplacee|deplace|bloquee|bloque|deplacee ou supprimee|deplace ou supprime|interrompue}|ne {repond|fonctionne|charge} {pas|plus}|{en|en cours de} maintenance|hors ligne|{a refuse la connexion|connexion refusee|connexion interrompue|echec de la connexion|connexion impossible}
{delai|delai d attente} {depasse|expire|de connexion a expire|de connexion depasse}|temps d attente depasse|erreur {interne|interne du serveur|inattendue|inconnue|serveur|du serveur}|{une erreur|une erreur inattendue|une erreur interne} {est survenue|s est produite}|quelque chose {s est mal passe|a mal tourne}|{a renvoye une|} reponse inattendue|requete {invalide|incorrecte|refusee}|trop de requetes
acces {refuse|interdit|non autorise}|l acces est {refuse|interdit}|vous n avez pas {acces|l autorisation|la permission|les droits|le droit}|{votre|la} session a expire|session {expiree|a expire}|{vous devez|veuillez} vous {connecter|reconnecter|identifier}|connectez vous|verification de votre navigateur
{activez|activer|autorisez|autoriser|reactivez} {javascript|les scripts|l execution des scripts|le contenu actif|les cookies}|{javascript|les scripts|les cookies} {est|sont|semble|semblent} {desactive|desactives|bloque|bloques|requis|necessaire|necessaires|etre desactive|etre desactives}|{javascript|les cookies} {doit|doivent} etre {active|actives}
{necessite|requiert|exige|a besoin de|a besoin d|fonctionne avec} {javascript|des scripts|scripts|les cookies}|ne {prend|prennent} pas en charge {javascript|les scripts|les cookies}|ne supporte pas {javascript|les scripts}|{utilisez|utiliser} un navigateur {avec javascript|qui execute javascript|qui prend en charge javascript}|{desactivez|desactiver} {le|votre} {bloqueur de scripts|bloqueur de publicites|bloqueur}
{texte de remplissage|texte factice|faux texte|texte d exemple|texte provisoire}
""",
    "es": """
no se {encontro|encuentra|ha encontrado|pudo encontrar|pudo cargar|puede cargar|puede mostrar|pudo mostrar|pudo conectar|puede conectar|puede acceder|puede abrir|pudo completar|pudo procesar|ha podido cargar|ha podido establecer}|no {encontrada|encontrado|disponible|existe|responde|respondio|respondio a tiempo|contesta|funciona|carga|cargo|autorizado}|ya no {existe|esta disponible}|no esta {disponible|accesible|autorizado|abierta a su cuenta|abierto a su cuenta}
no pudo {cargarse|mostrarse|abrirse}|{fue|ha sido|se ha} {retirada|retirado|eliminada|eliminado|movida|movido|bloqueada|bloqueado|movida o eliminada|movido o eliminado|interrumpida}|{esta|temporalmente|actualmente} {bloqueada|bloqueado|sobrecargada|sobrecargado|fuera de linea|fuera de servicio|en mantenimiento|inactivo|caido}|temporalmente {no disponible|fuera de servicio}|en mantenimiento|fuera de {servicio|linea}
{rechazo la conexion|conexion rechazada|conexion interrumpida|error de conexion|fallo la conexion}|{tiempo de espera|el tiempo de espera} {agotado|de la conexion}|se agoto el tiempo de espera|{ha ocurrido|se produjo|se ha producido|ocurrio} un error|error {interno|interno del servidor|inesperado|desconocido|del servidor}|algo {salio mal|ha salido mal|fue mal|fallo}|{devolvio una|} respuesta inesperada|solicitud {incorrecta|invalida|rechazada}|demasiadas {solicitudes|peticiones}
acceso {denegado|prohibido|restringido|no autorizado}|{no tiene|usted no tiene} {permiso|permisos|acceso|autorizacion}|{su|la} sesion {ha caducado|ha expirado|caduco|expiro}|sesion {caducada|expirada}|{inicie|debe iniciar|vuelva a iniciar} sesion|comprobando su navegador
{active|activar|permita|permitir|habilite|habilitar} {javascript|los scripts|las cookies|el contenido activo|la ejecucion de scripts}|{javascript|los scripts|las cookies} {esta|estan|parece estar} {desactivado|desactivados|deshabilitado|deshabilitados|deshabilitadas|bloqueado|bloqueados}|{javascript|las cookies} {debe|deben} estar {activado|activadas|habilitado|habilitadas}
{necesita|requiere|precisa|exige} {javascript|scripts|cookies|de javascript}|no {admite|soporta|es compatible con} {javascript|scripts|cookies}|{use|utilice} un navegador {con javascript|que ejecute javascript|que admita javascript}|{desactive|desactivar} {el|su} {bloqueador de scripts|bloqueador de anuncios|bloqueador}
{texto de relleno|texto de prueba|texto de ejemplo|texto simulado|texto provisional}
""",
}

# Words that such messages are made of.
WORDS = {
    "en": """
the a an this that these those it its you your our we us i is are was were be been being has have had do does did not no to of in on at for from with without by or and but if so as please sorry while then because due right now before after until may might can cannot could should must will would need needs here there again later soon back shortly once
page pages site website web server servers service services resource url uri address link file files document entry record item content request requested requests response browser browsers application app connection network host gateway upstream database backend system client account session user login password support administrator webmaster admin team contact help viewer view search export home homepage start menu
try retry reload refresh return go check checking click press continue continuing using use view access accessing see display show load loading rendering run running work working function functions properly correctly complete verify wait slow down quote ask visit find looking found typed moved make sure minutes minute seconds hours moment message code status error errors warning notice attention oops ooops whoops hmm unfortunately apologies inconvenience temporarily currently available unavailable time further
interactive full latest settings setting options portal region country device version id reference number ray javascript js java script scripts scripting cookies noscript html http https sign log in out off
don t doesn isn aren re ve ll m s couldn can wasn didn
""",
    "de": """
der die das den dem des ein eine einen einem einer diese dieser dieses diesen diesem sie ihr ihre ihren ihrem ihrer wir uns unser unsere es ist sind war wird werden wurde kann konnen muss mussen soll sein hat haben nicht kein keine keinen und oder aber wenn um zu zum zur auf in im an am bei beim vom von fur mit ohne durch wegen bis nach vor aus leider bitte da etwas hier noch wieder erneut einmal spater bald gleich zurzeit derzeit momentan vorubergehend zuerst
seite seiten website webseite internetseite server dienst adresse link datei dokument eintrag datensatz inhalt anfrage antwort browser anwendung app verbindung netzwerk datenbank system konto sitzung benutzer anmeldung passwort support administrator hilfe ansicht anzeige suche export ressource startseite
angeforderte angeforderten angeforderter gesuchte gesuchten gewunschte vollen volle versuchen laden neu aktualisieren prufen wenden klicken nutzen verwenden sehen anzeigen fortfahren fortzufahren zuruck zuzugreifen anmelden wiederkommen warten melden minuten minute sekunden fehler fehlercode code status hinweis warnung achtung meldung systemmeldung hoppla entschuldigung tut leid einstellungen javascript skripte cookies kurze
""",
    "fr": """
le la les l un une des du de d ce cette ces cet il elle vous votre vos nous notre nos que qui est sont etait sera a ont ete etre pas plus ne n et ou mais si pour afin avant apres pendant lors dans en sur sous avec sans par au aux y s se ici puis car encore tard bientot actuellement temporairement momentanement malheureusement desole desolee desoles veuillez merci
page pages site web serveur service adresse lien fichier document fiche contenu demande requete reponse navigateur application connexion reseau base donnees systeme compte session utilisateur assistance support administrateur aide vue visualiseur recherche export exportation ressource accueil
demandee demande recherchez recherchee cherchez reessayez reessayer rechargez recharger chargement actualisez verifiez contactez cliquez revenez retournez retour utiliser afficher voir continuer acceder fonctionner connecter complete minutes minute secondes erreur erreurs code statut avis avertissement attention message oups reglages parametres javascript scripts cookies correctement
""",
    "es": """
el la los las lo un una unos unas de del al este esta estos estas ese esa su sus usted nosotros nuestro nuestra que es son esta estan fue sera ha han sido ser estar no ya y e o u pero si para antes despues durante en con sin por a se me le aqui luego mas tarde pronto actualmente temporalmente momento lamentablemente desgracia sentimos favor gracias
pagina paginas sitio web servidor servicio direccion enlace archivo documento ficha contenido solicitud respuesta navegador aplicacion conexion red base datos sistema cuenta sesion usuario soporte asistencia administrador ayuda vista visor busqueda exportacion recurso inicio
solicitada solicitado busca buscada intentelo intente intentarlo nuevo vuelva volver recargue recargar cargar compruebe revise contacte pulse regrese usar ver mostrar continuar seguir acceder ejecutar funcionar iniciar completa correctamente minutos minuto segundos error errores codigo estado aviso advertencia atencion mensaje vaya ups ajustes configuracion javascript scripts cookies
""",
}

# Ends of a short note that stands for missing content.
FILLER_END = """
{goes|go|comes} here|to {follow|come|be written|be completed|be added|be supplied|be filled in|be determined|be announced|be provided|be confirmed|be decided}|will {follow|be added|be added later|be added soon|be provided|be provided later|be added by the author|follow later|appear here}|not yet {supplied|written|available|provided|delivered|added}|coming soon|comes later|yet to come|{still|is} missing|pending|is pending|{your|add|insert|enter|type} {text|content|title|name} here|type here|in preparation|under construction|{comes|follows} in the next {draft|version|revision}
folgt|folgt {noch|spater|in kurze|bald}|noch offen|wird {noch erganzt|erganzt|nachgereicht|spater erganzt|nachgetragen|noch nachgereicht}|noch {zu erganzen|zu schreiben|einzufugen|einzureichen|nicht geliefert|nicht verfugbar}|hier {einfugen|steht ihr text|text einfugen|text eingeben}|{ihr|text} {text hier|hier einfugen}|kommt {hier hin|hierher|noch|spater|im nachsten entwurf}|fehlt noch|ausstehend|in {arbeit|vorbereitung|kurze}|liegt noch nicht vor|zu erganzen|steht noch aus
a {completer|rediger|venir|ajouter|fournir|preciser|definir|completer ici|ajouter ici|inserer ici}|{votre|le|inserer le|saisir le} texte ici|texte ici|{va|vient|viendra} ici|viendra plus tard|pas encore {fourni|fournie|disponible|redige|redigee}|non {fourni|fournie|remis|remise}|en {attente|preparation|construction}|{manquant|manquante}|sera {ajoute|ajoutee|fourni|fournie|complete|completee} {plus tard|par l auteur|prochainement}|sera {ajoute|ajoutee}|dans la prochaine version|{prochainement|bientot disponible}
por {redactar|completar|anadir|escribir|entregar|incluir|definir|confirmar}|pendiente|pendiente de {redactar|completar|entregar}|va aqui|{su|tu|aqui va el|inserte el|insertar|escriba el} texto aqui|aqui va el texto|texto aqui|se anadira|se anadira {mas tarde|proximamente}|sin entregar|aun no {entregado|entregada|disponible}|vendra mas tarde|en {preparacion|construccion}|en la proxima version|falta por {redactar|completar}|sera anadido por el autor|proximamente
"""

# Words of the usual passage of dummy Latin.
LATIN = """
lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum
nec pellentesque orci vitae risus ultrices ac at donec mauris vel massa sem urna vestibulum curabitur praesent phasellus fusce nunc quam tortor nibh euismod integer aenean vivamus morbi tristique senectus netus malesuada fames turpis egestas proin maecenas suspendisse potenti nullam porta lacus sagittis
"""

# Usual names of template fields.
FIELDS = """
name|first name|last name|full name|your name|user|user name|username|email|email address|address|phone|company|company name|customer|customer name|client|client name|product|product name|price|city|country|subject|message|amount|url|id|value|date|time|year|author|title|version|batch|summary|abstract|text|content|body|contact|host|organism|species|strain|sample|project|sequence|length|protein|gene|accession|count|score|status|source|description|institution|lab|reference|doi|page|chapter|record|placeholder
vorname|nachname|anrede|firma|kunde|kundenname|datum|titel|betreff|ort|prenom|nom|nom du client|entreprise|societe|adresse|objet|titre|nombre|apellido|apellidos|nombre del cliente|empresa|fecha|titulo|asunto
"""

# Words of sentences that explain a field instead of leaving it unfilled.
ABOUT = """
template|templates|macro|field|fields|placeholder|placeholders|variable|variables|replaced|replace|replaces|substituted|filled|rendered|syntax|vorlage|vorlagen|platzhalter|ersetzt|ersetzen|feld|felder|eingesetzt|modele|modeles|gabarit|champ|champs|remplace|remplacee|remplacer|plantilla|plantillas|campo|campos|sustituye|sustituido|sustituir|reemplaza|reemplazado
"""
