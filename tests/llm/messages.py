"""Messages of common servers, browsers and sites, written down without regard to the test tables."""

#: Looked at while the lexicon was written.
SEEN = (
    'Oops! That page can’t be found.',
    'JavaScript must be enabled in order for you to use this site.',
    'Hmm. We’re having trouble finding that site.',
    'This page isn’t working right now',
    'The server at the given address is taking too long to respond.',
    "Sorry, this page isn't available.",
    'The link you followed may be broken, or the page may have been removed.',
    'This video is no longer available because the account has been terminated.',
    'Video unavailable',
    'This content is not available in your country.',
    'The file you are trying to download is no longer available.',
    'You have exceeded a secondary rate limit. Please wait a few minutes before you try again.',
    'Your IP address has been temporarily banned.',
    'The service is unavailable.',
    'The website cannot display the page',
    'An unexpected error occurred. Please reload the page.',
    'Web server is down',
    'Connection timed out',
    'Origin DNS error',
    'Access to this page has been denied because we believe you are using automation tools to browse the website.',
    'Our systems have detected unusual traffic from your computer network.',
    'The system cannot find the file specified.',
    'Server is too busy',
    'Your account has been locked.',
    'The download quota for this file has been exceeded.',
    'Invalid token or session expired, please log in again.',
    'Resource Limit Is Reached',
    'This app needs JavaScript to work.',
    'Please enable scripts and reload this page.',
    'For full functionality of this site it is necessary to enable JavaScript.',
    'Seite nicht gefunden',
    'Die Webseite ist nicht erreichbar',
    'Diese Website benötigt JavaScript.',
    'Zugriff verboten',
    'Der Server ist überlastet. Bitte versuchen Sie es später erneut.',
    'Page introuvable',
    'Accès refusé',
    'Ce site est inaccessible',
    'Le service est temporairement indisponible.',
    'JavaScript est désactivé dans votre navigateur.',
    'Página no encontrada',
    'No se puede acceder a este sitio web',
    'El archivo solicitado ha sido eliminado.',
    'Acceso denegado',
    'Para utilizar este sitio debe habilitar JavaScript.',
    'Pagina non trovata',
    'Impossibile raggiungere il sito',
    'Accesso negato',
    'Página não encontrada',
    'Este site precisa de JavaScript para funcionar.',
    'Acesso negado',
    'Strona nie została znaleziona',
    'Odmowa dostępu',
    'Ta strona wymaga włączonej obsługi JavaScript.',
    'Sayfa bulunamadı',
    'Erişim engellendi',
    'Страница не существует или была удалена.',
    'Доступ запрещён',
    'Не удалось подключиться к серверу',
    'Для работы сайта необходимо включить JavaScript.',
    'الصفحة المطلوبة غير موجودة',
    'تعذر الوصول إلى هذا الموقع',
    'このサイトにアクセスできません',
    'お探しのページは存在しません。',
    'JavaScriptを有効にしてください',
    'サーバーエラーが発生しました',
    'Pagina niet gevonden',
    'Sidan kunde inte hittas',
    '您访问的页面不存在',
    '페이지를 찾을 수 없습니다',
    'This page could not be displayed.',
    'The document you requested is missing.',
    "Sorry, we can't find that page.",
    'Access to the requested file is restricted.',
    'Your request has been blocked by the security service.',
    'The upload service is down for maintenance, please check back soon.',
    'We are experiencing technical difficulties with our servers.',
    'Your free trial limit has been reached. Please upgrade your account.',
    'The page you are trying to visit does not exist.',
    'Something went wrong while loading this content.',
    'Unable to load the file. Please check your connection.',
    'The domain name has expired.',
    "Request blocked. We can't connect to the server for this app or website at this time.",
    'This account is private or has been deleted.',
    'This file was deleted by its owner.',
    'Unexpected end of file in parser.php on line 12',
    'Database error: could not select database',
    'Scripts are disabled. Please allow them to view this page.',
    'JavaScript is required',
    'Your browser has JavaScript turned off.',
    'Please activate JavaScript in your browser to use this website.',
    'Die Seite konnte nicht gefunden werden.',
    'Diese Datei wurde vom Benutzer gelöscht.',
    'Wartungsarbeiten. Bitte versuchen Sie es in einigen Minuten erneut.',
    'Sie müssen JavaScript aktivieren, um diese Seite zu sehen.',
    "Le fichier demandé n'existe pas.",
    'La connexion au serveur a échoué.',
    "Cette vidéo n'est plus disponible.",
    'Vous devez activer JavaScript pour utiliser ce site.',
    'El servidor no responde.',
    'Este contenido no está disponible en su país.',
    'Error al cargar el archivo.',
    'Necesita activar JavaScript en el navegador.',
    'Il server non risponde.',
    'Il file richiesto non esiste.',
    'Questo contenuto non è disponibile.',
    'Attiva JavaScript per continuare.',
    'O servidor não está respondendo.',
    'O arquivo foi removido pelo usuário.',
    'Este conteúdo não está disponível.',
    'Habilite o JavaScript no seu navegador.',
    'Plik został usunięty.',
    'Błąd połączenia z bazą danych.',
    'Serwis jest chwilowo niedostępny.',
    'Proszę włączyć JavaScript.',
    'Sunucuya bağlanılamadı.',
    'Bu içerik kullanılamıyor.',
    'Dosya silinmiş.',
    'JavaScript etkin değil.',
    'Файл не найден.',
    'Сервер временно недоступен.',
    'Ваш аккаунт заблокирован.',
    'Для просмотра страницы включите JavaScript.',
    'حدث خطأ في الخادم',
    'تم حذف الملف',
    'يجب تفعيل جافا سكريبت',
    'アクセスが拒否されました',
    'ファイルは削除されました。',
    'この動画は利用できません',
    'JavaScriptが無効になっています。',
    "We're sorry, the page you requested cannot be found.",
    'The resource you are looking for has been removed, had its name changed, or is temporarily unavailable.',
    'Application error: a client-side exception has occurred',
    'Your session timed out due to inactivity.',
    'Too many login attempts. Please try again in 15 minutes.',
    'This subtitle file is not available.',
    'The server returned an invalid response.',
    'Download limit exceeded. Upgrade to premium to continue.',
    'Temporary failure in name resolution',
    'Cannot connect to the database server.',
    'File not found: /var/www/html/download.php',
    'You are not authorized to view this page.',
    'This content has been blocked in your region.',
    'The site is currently undergoing scheduled maintenance.',
    'Bot verification failed. Please complete the captcha.',
    'This link is no longer valid.',
    'Our service is currently unavailable. Please check back later.',
    'Error loading page. Please refresh your browser.',
    'The file has been deleted for violating our terms of service.',
    'JavaScript appears to be disabled. Please enable it to use this page.',
    'This website needs cookies and JavaScript to function.',
    'Scripts must be allowed for this page to load.',
    'Fehler 404: Die angeforderte Seite existiert nicht.',
    'Ihre Sitzung ist abgelaufen.',
    'Der Zugriff auf diese Datei wurde gesperrt.',
    'Bitte JavaScript im Browser aktivieren.',
    'Erreur interne du serveur',
    'Votre session a expiré, veuillez vous reconnecter.',
    'Le lien que vous avez suivi a expiré.',
    "Merci d'activer JavaScript dans votre navigateur.",
    'Error interno del servidor',
    'Su sesión ha caducado.',
    'El enlace ha expirado.',
    'Esta página requiere JavaScript.',
    'Errore interno del server',
    'La sessione è scaduta.',
    'Il file è stato rimosso.',
    'È necessario abilitare JavaScript.',
    'Erro interno do servidor',
    'A sua sessão expirou.',
    'O link expirou.',
    'Esta página requer JavaScript.',
    'Wewnętrzny błąd serwera',
    'Twoja sesja wygasła.',
    'Plik nie istnieje.',
    'JavaScript jest wyłączony.',
    'Sunucu hatası oluştu.',
    'Oturumunuzun süresi doldu.',
    'Bu sayfa için JavaScript gereklidir.',
    'Внутренняя ошибка сервера',
    'Срок действия ссылки истёк.',
    'Файл был удалён.',
    'В вашем браузере отключен JavaScript.',
    'الخادم غير متاح حاليا',
    'انتهت صلاحية الجلسة',
    'يتطلب هذا الموقع تفعيل جافا سكريبت',
    'セッションの有効期限が切れました。',
    'サーバーに接続できません',
    'ファイルが見つかりません',
    'このページを表示するにはJavaScriptが必要です。',
    "The address wasn't understood",
    'Secure connection failed',
    'Problem loading page',
    'This webpage has a redirect loop',
    'No internet connection',
    'The proxy server is refusing connections.',
    'Sorry, the file you have requested has been deleted.',
    'This channel does not exist.',
    'Your subscription has expired.',
    'Requests from your network are being rate limited.',
    'You are being rate limited',
    'The archive is damaged and cannot be opened.',
    'The page took too long to load and was stopped.',
    'This host has been suspended for non-payment.',
    "We couldn't process your request. Please try again.",
    'Parse error: syntax error, unexpected token',
    'Enable JavaScript to see this content.',
    'Turn JavaScript on to use the viewer.',
    'Die Verbindung wurde unterbrochen.',
    'Dieses Video ist in Ihrem Land nicht verfügbar.',
    'Ihr Konto wurde gesperrt.',
    'JavaScript ist deaktiviert.',
    "La page que vous cherchez n'existe plus.",
    'Trop de requêtes',
    'Ce compte a été suspendu.',
    'JavaScript doit être activé.',
    'La conexión ha expirado.',
    'Demasiadas solicitudes',
    'Esta cuenta ha sido suspendida.',
    'JavaScript está desactivado.',
    'Connessione interrotta',
    'Troppe richieste',
    'Pagina inesistente',
    'JavaScript è disattivato.',
    'A ligação expirou.',
    'Demasiados pedidos',
    'Esta conta foi suspensa.',
    'O JavaScript está desativado.',
    'Połączenie zostało przerwane.',
    'Zbyt wiele żądań',
    'Konto zostało zawieszone.',
    'Bağlantı kesildi.',
    'Çok fazla istek',
    'Hesap askıya alındı.',
    'Соединение прервано.',
    'Слишком много запросов',
    'Аккаунт удалён.',
    'JavaScript отключён.',
    'انقطع الاتصال',
    'الحساب معلق',
    '接続が中断されました',
    'リクエストが多すぎます',
    'アカウントが停止されました',
    'JavaScriptがオフになっています',
    'The web page you have entered does not exist on our servers.',
    'This item has been removed by the moderators.',
    'Service overloaded, please retry.',
    'You need permission to open this document.',
    'The certificate of this site is not trusted.',
    'Your download link was already used.',
    'Captcha required',
    'Sorry, this service is not offered in your country.',
    'Connection reset by peer',
    'Segmentation fault (core dumped)',
    'Out of disk space on the server',
    'Unhandled exception in request handler',
    'This website is for sale!',
    'The media could not be loaded, either because the server or network failed or because the format is not supported.',
    'Verifying that you are not a bot.',
    'This player requires JavaScript.',
    'Without scripts this page cannot be shown.',
    'Unblock scripts for this site and try again.',
    'Die gesuchte Seite wurde verschoben.',
    'Sie haben keine Berechtigung für diesen Ordner.',
    'Ein unerwarteter Fehler ist aufgetreten.',
    'Skripte müssen erlaubt sein, damit die Seite geladen wird.',
    'Le serveur est en cours de maintenance.',
    "Vous n'avez pas les droits pour accéder à ce dossier.",
    "Une erreur inattendue s'est produite.",
    'Autorisez les scripts pour afficher cette page.',
    'El sitio está en mantenimiento.',
    'No tiene permiso para ver esta página.',
    'Se ha producido un error inesperado.',
    'Permita los scripts para ver la página.',
    'Il sito è in manutenzione.',
    'Non hai i permessi per accedere a questa pagina.',
    'Si è verificato un errore imprevisto.',
    'Gli script devono essere attivati.',
    'O site está em manutenção.',
    'Não tem permissão para aceder a esta página.',
    'Ocorreu um erro inesperado.',
    'Permita scripts para ver esta página.',
    'Trwają prace konserwacyjne na serwerze.',
    'Nie masz uprawnień do tej strony.',
    'Wystąpił nieoczekiwany błąd.',
    'Site bakımda, lütfen daha sonra deneyin.',
    'Bu sayfayı görüntüleme izniniz yok.',
    'Beklenmeyen bir hata oluştu.',
    'На сайте ведутся технические работы.',
    'У вас нет прав для просмотра этой страницы.',
    'Произошла непредвиденная ошибка.',
    'الموقع تحت الصيانة',
    'ليس لديك إذن للوصول إلى هذه الصفحة',
    'حدث خطأ غير متوقع',
    'ただいまメンテナンス中です',
    'このページを表示する権限がありません',
    '予期しないエラーが発生しました',
)
#: Tried once, after the lexicon was finished.
HELD_OUT = (
    'Sorry, you do not have access to this folder.',
    'The service did not respond in time.',
    'We could not verify your browser.',
    'This download has expired or does not exist.',
    'Unable to open the requested stream.',
    'An internal error prevented the page from loading.',
    'Blocked by your network administrator.',
    'Too many connections, try again in a few minutes.',
    'The site is closed for updates.',
    'Invalid URL',
    'Your browser must allow JavaScript for this page.',
    'JavaScript is turned off, so the player cannot load.',
    'Die Datei ist beschädigt und kann nicht geöffnet werden.',
    'Der Link ist ungültig.',
    'Zu viele Anfragen, bitte warten Sie.',
    'JavaScript muss aktiviert sein.',
    'Le fichier a été supprimé par son propriétaire.',
    "La page n'a pas pu être chargée.",
    'Accès interdit',
    'JavaScript est nécessaire pour ce site.',
    'No se pudo cargar la página.',
    'El archivo está dañado.',
    'Acceso prohibido',
    'JavaScript es necesario para ver esta página.',
    'Impossibile caricare la pagina.',
    'Il collegamento non è valido.',
    'Não foi possível carregar a página.',
    'A ligação não é válida.',
    'Nie udało się załadować strony.',
    'Łącze jest nieprawidłowe.',
    'Sayfa yüklenemedi.',
    'Geçersiz bağlantı',
    'Не удалось загрузить страницу.',
    'Недействительная ссылка',
    'تعذر تحميل الصفحة',
    'الرابط غير صالح',
    'ページを読み込めませんでした',
    'リンクが無効です',
    'De pagina kon niet worden geladen.',
    'Sidan finns inte längre.',
)
