"""Seed texts of the residue models: what public software ships or prints. They start the models, which then learn from all pages."""

from __future__ import annotations

import random
from http import HTTPStatus

#: Words of the classical filler text (Cicero, De finibus 1.10.32 f.).
LATIN = (
    "sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium totam rem aperiam eaque ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo nemo enim ipsam "
    "voluptatem quia voluptas aspernatur aut odit fugit consequuntur magni dolores eos qui ratione sequi nesciunt neque porro quisquam est dolorem ipsum dolor amet consectetur adipisci velit non numquam eius modi tempora incidunt labore "
    "dolore magnam aliquam quaerat lorem adipiscing elit do eiusmod tempor incididunt magna aliqua ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit cillum "
    "eu fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim id laborum"
).split()
#: What site builders and content systems put where the owner has not written yet.
BUILDER = [
    "Hello world! Welcome to WordPress. This is your first post. Edit or delete it, then start writing!", "This is an example page.", "Sample Page", "Just another WordPress site", "This is an example of a page.", "Your tagline here",
    "I'm a paragraph. Click here to add your own text and edit me.", "It's easy. Just click Edit Text or double click me to add your own content and make changes to the font.", "Use this space to tell people about your business.", "This is a great place to tell a story about your company.",
    "Add your heading text here", "Click edit button to change this text.", "Click the edit button to edit this block.", "Enter your text here", "Type your text here", "Write your text here", "Put your text here", "Your text goes here", "Your content goes here", "Your title here", "Title here", "Subtitle here", "Heading goes here",
    "Insert your content here", "Replace this text with your own.", "Replace this paragraph.", "Replace me", "This is placeholder text.", "This is dummy text.", "This is sample content.", "This text is only a placeholder and will be replaced.", "Placeholder", "Dummy copy", "Sample content", "Sample title", "Example text", "Example title",
    "Describe your product here.", "Describe the service in a few words.", "Write a short description here.", "Short description of this item.", "Describe what you offer to your customers.", "Add a description.", "Add a caption here.", "Image title", "Image description", "Button label", "Click me", "Item one", "Item two", "List item", "Service one", "Service two", "Feature title", "Feature description", "Name of the team member", "Job title", "Customer name", "A quote from a happy customer goes here.",
    "Tell your visitors who you are and what you do.", "Introduce yourself and your team.", "Tell the story of your business here.", "Add your opening times here.", "Add your address here.", "Put the phone number here.", "Write a few sentences about your company.", "Content to be written.", "Text to follow.", "Copy to come.", "TODO: write this section", "To do: add content", "Content coming from the client", "This section has no content yet.", "This block is empty.", "Remove this text before publishing.", "Edit this text in the page settings.",
    "Hier steht Ihr Text.", "Hier können Sie Ihren Text einfügen.", "Platzhalter", "Dies ist ein Beispieltext.", "Blindtext", "Klicken Sie hier, um Ihren eigenen Text einzufügen.", "Fügen Sie eine Beschreibung hinzu.", "Ihre Überschrift hier",
    "Escribe aquí tu texto.", "Texto de muestra", "Este es un texto de ejemplo.", "Haz clic aquí para agregar tu propio texto.", "Añade una descripción aquí.", "Su contenido aquí", "Título de ejemplo",
    "Votre texte ici.", "Ceci est un texte d'exemple.", "Texte de remplacement", "Cliquez ici pour ajouter votre texte.", "Ajoutez une description ici.", "Saisissez votre texte", "Votre titre ici",
]
#: Names of form and customer fields, and the marks that template languages and mail merges put round them.
FIELDS = (
    "name first_name last_name full_name firstname lastname title company company_name business business_name organization owner contact customer client user username email e-mail phone telephone fax mobile address street city town state region province county zip zipcode postcode country "
    "location area service services product product_name item price amount total quantity date day month year time hours open_hours website url link domain site site_name site.title page.title post.title description summary text content body image logo slogan industry category store branch manager agent signature number id"
).split()
WORDS = "your company|your name|your city|your business|your phone number|your address|your email|company name|business name|city|state|city, state|phone number|street address|name|first name|date|insert city|insert name here|insert text|add address|add phone|enter name|service area|owner name|business type|Ihr Name|Firmenname|Ort|Stadt|Telefonnummer|su nombre|nombre de la empresa|ciudad|teléfono|votre nom|nom de la société|ville|téléphone|Name einfügen|Stadt einfügen|Text einfügen|Telefon einfügen|Straße eingeben|insertar nombre|insertar teléfono|insertar ciudad|insérer le nom|insérer la ville|insérer le texte".split("|")
MARKS = ["{{%s}}", "{{ %s }}", "{{{%s}}}", "{%%%s%%}", "{%% %s %%}", "{%s}", "${%s}", "$%s$", "#{%s}", "<%%= %s %%>", "<%%%s%%>", "%%%%%s%%%%", "%%%s%%", "[[%s]]", "[[ %s ]]", "[%s]", "<<%s>>", "<%s>", "@@%s@@", "@%s@", "*|%s|*", "__%s__", "##%s##", "#%s#", "«%s»", "~~%s~~"]
#: What programs print for a value that is missing, and marks of text not yet written.
MISSING = ["undefined", "NaN", "null", "%s", "%d", "%1$s", "{0}", "{1}", "[object Object]", "None", "TBD", "TODO", "FIXME", "XXXX", "XXXXXXXX", "YOUR_NAME", "YOUR_CITY", "INSERT_TEXT", "INSERT_PHONE", "ADD_ADDRESS", "TODO_HEADLINE", "TBD_HOURS", "COMPANY_NAME", "YOUR COMPANY NAME", "YOUR NAME HERE", "INSERT CITY HERE", "ADD PHONE NUMBER", "YOUR LOGO", "COMPANY NAME HERE", "Undefined variable", "Undefined index", "Undefined array key", "undefined undefined", "NaN NaN"]
#: What web servers, proxies, content systems, databases, hosting and browsers' fall-backs say instead of content.
NOTICES = [
    "Not Found. The requested URL was not found on this server.", "Additionally, a 404 Not Found error was encountered while trying to use an ErrorDocument to handle the request.", "The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.", "Sorry, the page you were looking for doesn't exist.", "We can't find the page you requested.", "The link may be broken or the page may have been moved.", "Oops! That page can't be found.", "Nothing was found at this location.", "File not found.", "This page does not exist any more.", "The resource you requested has been removed.", "This content is no longer available.", "Page not found", "Error 404", "404 Error", "Gone",
    "You don't have permission to access this resource.", "You don't have permission to access this server.", "Access to this page has been denied.", "Access denied. You do not have access to this site.", "Sorry, you have been blocked. You are unable to access this site.", "This website is using a security service to protect itself from online attacks.", "Your IP address has been blocked.", "Your request has been blocked by the firewall.", "This website is not available in your country.", "Why have I been blocked?", "Reference number", "Incident ID", "Your request looks automated.",
    "Checking your browser before accessing the site.", "Please stand by, while we are checking your browser.", "Checking if the site connection is secure.", "This process is automatic. Your browser will redirect to your requested content shortly.", "Verifying you are human. This may take a few seconds.", "Please complete the security check to access the site.", "Please verify that you are not a robot.", "Solve the captcha to continue.", "Just a moment...", "Please wait while your request is being verified.", "One more step", "DDoS protection", "Attention Required!", "Press and hold to confirm you are a human.", "Are you a robot?",
    "Too many requests. Please slow down and try again later.", "You have exceeded the rate limit.", "You are being rate limited.", "Request limit reached, please try again in a few minutes.", "The server encountered an internal error or misconfiguration and was unable to complete your request.", "Please contact the server administrator and inform them of the time the error occurred.", "More information about this error may be available in the server error log.", "There has been a critical error on this website.", "The website encountered an unexpected error. Please try again later.", "Something went wrong.", "Oops, an error occurred.", "An error has occurred while processing your request.", "We're sorry, but something went wrong.", "Application error: a client-side exception has occurred.", "Server Error in '/' Application. Runtime Error", "HTTP Status 500 - Internal Server Error", "Our team has been notified and is working on it.",
    "Error establishing a database connection.", "SQLSTATE[HY000] [2002] Connection refused", "You have an error in your SQL syntax", "Table is marked as crashed and should be repaired", "Could not connect to MySQL server", "Too many connections", "Warning: include(): failed to open stream: No such file or directory in /var/www/html/index.php on line 12", "Warning: mysqli_connect(): Access denied for user", "Fatal error: Uncaught Error: Call to undefined function in /home/site/public_html/wp-content/plugins", "Fatal error: Allowed memory size exhausted", "Parse error: syntax error, unexpected end of file", "Notice: Undefined index in", "Deprecated: Function is deprecated in", "Traceback (most recent call last):", "Exception in thread main java.lang.NullPointerException", "Stack trace: #0 {main} thrown in", "Unhandled exception", "Object reference not set to an instance of an object.", "No input file specified.", "Cannot GET /",
    "The server returned an invalid or incomplete response.", "The proxy server received an invalid response from an upstream server.", "The gateway did not receive a timely response from the upstream server.", "upstream connect error or disconnect/reset before headers", "The web server reported a bad gateway error.", "The origin web server is not reachable.", "Connection timed out.", "The connection has timed out.", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.", "The service is unavailable.", "No server is available to handle this request.", "The site is currently overloaded.", "Resource limit is reached. The website is temporarily unable to service your request as it exceeded resource limit.", "Bandwidth limit exceeded. The server is temporarily unable to service your request due to the site owner reaching their bandwidth limit.",
    "Briefly unavailable for scheduled maintenance. Check back in a minute.", "We are currently performing maintenance. We will be back soon.", "Our site is undergoing scheduled maintenance.", "Site is under maintenance. Please check back later.", "We'll be back shortly. Thank you for your patience.", "We are down for maintenance.", "Maintenance mode is on. Site will be available soon.", "This website is under construction.", "Our website is coming soon.", "Coming soon. We are working hard to bring you our new website.", "Something new is on its way. Stay tuned!", "New website launching soon", "Future home of something quite cool.", "This page is being updated.", "Site under development",
    "This domain is for sale.", "Buy this domain.", "The domain may be for sale by its owner.", "This domain is parked free, courtesy of the registrar.", "This Web page is parked.", "Interested in this domain? Make an offer.", "This domain has recently been registered.", "This domain name has expired. Renew it now.", "Related links and sponsored listings. The domain owner has no relationship with advertisers.", "Get this domain", "Inquire about this name.", "The sponsored listings displayed above are served automatically by a third party.", "This account has been suspended. Contact your hosting provider for more information.", "Account Suspended", "This site has been suspended for non-payment.", "This hosting account is inactive.", "This site has been deactivated by the owner.", "This store is unavailable.", "The website owner has not paid for hosting.", "Website expired",
    "Welcome to nginx! If you see this page, the nginx web server is successfully installed and working. Further configuration is required.", "It works!", "Apache2 Default Page. This is the default welcome page used to test the correct operation of the server after installation.", "Congratulations! Your web server is up and running.", "This is the default web page for this server. The web server software is running but no content has been added, yet.", "There is no website configured at this address.", "Default Web Site Page", "Welcome to your new server. Replace this file with your own index page.", "Index of / Name Last modified Size Description Parent Directory", "Directory listing for /", "backup.zip 2021-03-04 10:11 12M", "index.html.old 2019-05-06 1.2K", "Future home of your website. Upload your website files to public_html.",
    "Please log in to continue.", "You must be logged in to view this page.", "Your session has expired. Please log in again.", "Session timed out due to inactivity.", "This page is password protected.", "Authentication required", "Sign in to view this content.", "The page isn't redirecting properly.", "Your connection is not private.", "Invalid SSL certificate", "The request could not be satisfied.", "This site can't be reached.",
    "You need to enable JavaScript to run this app.", "Please enable JavaScript to continue using this application.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.", "JavaScript is required to view this page.", "This site requires JavaScript. Please turn it on in your browser settings.", "Enable JavaScript and cookies to continue.", "JavaScript is disabled in your browser.", "Your browser does not support JavaScript or it is turned off.", "Scripts are blocked by your browser. Allow scripts and reload the page.", "This page cannot be displayed without scripts.", "Please allow active scripting to see this content.", "Your browser is out of date. Please upgrade to use this site.", "Loading, please wait...", "Loading...", "If this page does not load, please check your browser settings.", "The content of this page is loaded by a script.", "noscript", "Turn on JavaScript",
    "Go to the home page", "Return to homepage", "Back to home", "Try again", "Reload the page", "Please try again later.", "Contact the site owner if the problem persists.", "Try searching instead.", "Report this issue", "Check the address and try again.",
    "Seite nicht gefunden", "Die gewünschte Seite konnte nicht gefunden werden.", "Die angeforderte Seite existiert nicht mehr.", "Zugriff verweigert", "Interner Serverfehler", "Es ist ein Fehler aufgetreten.", "Bitte versuchen Sie es später noch einmal.", "Diese Website wird gerade gewartet.", "Wegen Wartungsarbeiten vorübergehend nicht erreichbar.", "Hier entsteht eine neue Internetpräsenz.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Diese Seite benötigt JavaScript.", "Diese Domain steht zum Verkauf.", "Fehler 404",
    "Página no encontrada", "La página solicitada no existe.", "Lo sentimos, no pudimos encontrar esa página.", "Acceso denegado", "Error interno del servidor", "Se ha producido un error.", "Inténtelo de nuevo más tarde.", "Sitio web en mantenimiento", "Estamos realizando tareas de mantenimiento.", "Página en construcción", "Active JavaScript en su navegador para continuar.", "Este sitio necesita JavaScript.", "Este dominio está en venta.",
    "Page non trouvée", "La page que vous recherchez est introuvable.", "Cette page n'existe plus.", "Accès refusé", "Erreur interne du serveur", "Une erreur s'est produite.", "Veuillez réessayer plus tard.", "Site en cours de maintenance", "Notre site est actuellement en maintenance.", "Site en construction", "Veuillez activer JavaScript dans votre navigateur.", "Ce site nécessite JavaScript.", "Ce domaine est à vendre.",
]
#: Ordinary sentences of business sites, some of which speak of errors, building work, samples or scripts.
PROSE = [
    "We have served families in this town for three generations.", "Call us for a free estimate before you decide.", "Our office is open from Monday to Friday, nine to five.", "Walk-ins are welcome, but appointments are served first.", "We repair, clean and install all common brands.", "Parking is behind the building.", "Most jobs are done within a day.", "The team has more than twenty years of experience.", "All work comes with a written warranty.", "Please bring your insurance card to the first visit.",
    "We design websites and repair broken ones, from error pages to slow databases.", "The road in front of the shop is under construction; use the side entrance.", "Our new branch is coming soon to the north side.", "The course teaches JavaScript to beginners on Tuesday evenings.", "If your dashboard shows an error code, bring the car in.", "Access for wheelchairs is at the rear door.", "We found the missing page of the church register.", "Samples of our carpets are on display.", "A template for the cutting is included.", "The domain of the old castle begins at the bridge.", "Maintenance plans start at a fixed monthly price.", "Service is not available on public holidays.", "You will find a list of our services below.", "Try our soup; it is made fresh every morning.", "Enter through the red door and ask for the manager.", "Add a name to the cake for free.", "Please describe the noise when you call.", "Your first lesson is free of charge.", "The choir sings in Latin on Sundays.", "Printers use dummy text so that readers look at the layout.",
    "Wir sind seit dreißig Jahren für Sie da.", "Rufen Sie uns an, wir beraten Sie gern.", "Unsere Werkstatt liegt direkt am Bahnhof.", "Estamos abiertos de lunes a sábado.", "Llámenos para pedir un presupuesto gratuito.", "Nuestro taller repara todas las marcas.", "Nous sommes ouverts du mardi au samedi.", "Appelez-nous pour un devis gratuit.", "Notre équipe vous accueille toute la journée.",
    "About us", "Contact", "Our services", "Opening hours", "Our team", "Prices", "Reviews", "Gallery", "Questions", "Directions", "Subscribe to our newsletter.", "All rights reserved.", "We use cookies to improve this site.", "Follow us", "Share this page", "Home", "Read more", "Book now", "Monday to Friday 8 am to 6 pm", "Closed on Sunday",
]
#: Bracketed words of ordinary text.
BRACKETS = "[1] [2] [12] [...] [sic] [and] [the] [not] [our] [we] [most] [all] [some] [only] [new] [on] [off] [at] [dot] [edit] [pdf] [video] [map] [open] [closed] [free] [sale] [sold] [hide] [show] [more] [here] [now] [x] [a] [in] [optional] [bold] [today only] [laughs] [applause] {a} <3".replace(" only", "_only").split()


def filler_texts(seed: int = 5) -> list[str]:
    rnd = random.Random(seed)
    return BUILDER * 6 + [" ".join(rnd.choice(LATIN) for _ in range(rnd.randint(4, 14))) for _ in range(500)]


def placeholder_texts() -> list[str]:
    named = [w for f in FIELDS for w in (f, f.upper(), f.replace("_", " "), f.replace("_", " ").title())] + [v for w in WORDS for v in (w, w.upper(), w.title())]
    return [m % n for n in named for m in MARKS] + MISSING * 40


def notice_texts() -> list[str]:
    codes = [t for s in HTTPStatus if s >= 400 for t in (f"{s.value} {s.phrase}", s.phrase, f"Error {s.value}", f"HTTP Error {s.value} - {s.phrase}", s.description) if t]
    return (NOTICES + codes) * 3


def prose_texts() -> list[str]:
    return PROSE * 3 + [b.replace("_only", " only") for b in BRACKETS] * 30
