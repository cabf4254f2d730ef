"""What servers, programs and sites say instead of a text, and dummy text: public lists, a lexicon and known phrases.

A unit is a message if nearly all its words of weight belong to the vocabulary of such messages, and it names both a thing (page, server,
script, ...) and its state (not found, denied, required, ...). Known phrases (the public ones below and those a corpus repeats, see residue)
are compared by short letter sequences after folding letters that character recognition confuses, so that damage doesn't hide them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import xxhash

# --- Fixed values: public lists ---------------------------------------------------------------------------------------
#: Reason phrases of HTTP.
STATUS = (
    "Bad Request", "Unauthorized", "Authorization Required", "Payment Required", "Forbidden", "Not Found", "Method Not Allowed",
    "Not Acceptable", "Proxy Authentication Required", "Request Timeout", "Conflict", "Gone", "Length Required", "Precondition Failed",
    "Payload Too Large", "URI Too Long", "Unsupported Media Type", "Range Not Satisfiable", "Expectation Failed", "Misdirected Request",
    "Unprocessable Content", "Locked", "Failed Dependency", "Too Early", "Upgrade Required", "Precondition Required", "Too Many Requests",
    "Request Header Fields Too Large", "Unavailable For Legal Reasons", "Internal Server Error", "Not Implemented", "Bad Gateway",
    "Service Unavailable", "Service Temporarily Unavailable", "Gateway Timeout", "Gateway Time-out", "HTTP Version Not Supported",
    "Insufficient Storage", "Loop Detected", "Bandwidth Limit Exceeded", "Network Authentication Required",
)
#: Messages of common servers, browsers and site software.
MESSAGES = (
    "The requested URL was not found on this server.", "You don't have permission to access this resource.", "Apache Server at Port", "nginx", "It works!",
    "The server encountered an internal error or misconfiguration and was unable to complete your request.", "Error establishing a database connection",
    "Sorry, you have been blocked", "Checking your browser before accessing", "Verify you are human by completing the action below.",
    "This site can't be reached", "Your connection is not private", "The connection has timed out", "Unable to connect",
    "Briefly unavailable for scheduled maintenance. Check back in a minute.", "There has been a critical error on this website.",
    "Your browser sent a request that this server could not understand.", "HTTP Error", "Traceback (most recent call last):",
    "No such file or directory", "Fatal error: Uncaught exception", "Maximum execution time exceeded", "Request ID:", "Ray ID:",
)
#: Notices that scripts are required, as common frameworks print them.
SCRIPTS = (
    "You need to enable JavaScript to run this app.", "We're sorry but this app doesn't work properly without JavaScript enabled. Please enable it to continue.",
    "Please enable JavaScript and cookies to continue", "Please turn JavaScript on and reload the page.", "Loading...",
)
#: Words of the customary dummy Latin.
LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt "
    "culpa qui officia deserunt mollit anim id est laborum".split()
)
#: Rows of a keyboard, along which noise is typed.
ROWS = ("qwertyuiop", "asdfghjkl;", "zxcvbnm,./", "qwertzuiop", "yxcvbnm", "azertyuiop", "qsdfghjklm", "йцукенгшщзхъ", "фывапролджэ", "1234567890")

# --- Fixed values: beginnings of words in messages, by what they tell (English, German, French, Spanish, Portuguese, Italian, Dutch, Swedish,
# Polish, Turkish, Russian, Ukrainian, Arabic, Japanese, Chinese, Korean) ----------------------------------------------
#: Things that a message can be about.
THINGS = (
    "page site website webpage server service file document resource url address link account session request download connection network database domain host "
    "gateway proxy access browser app application api token certificate traffic captcha robot bot security http url content video database error router upstream "
    "seite webseite dienst datei dokument adresse verbindung zugriff zugang konto sitzung anfrage anforderung herunterladen netzwerk datenbank inhalt fehler "
    "page fichier serveur adresse lien compte connexion accès contenu requête ressource téléchargement navigateur erreur "
    "página sitio archivo fichero servidor dirección enlace cuenta sesión solicitud conexión acceso contenido recurso descarga navegador error "
    "ficheiro arquivo servidor endereço ligação conexão conta sessão pedido acesso conteúdo recurso transferência erro pagina "
    "sito collegamento connessione richiesta risorsa contenuto scaricamento errore indirizzo sessione accesso "
    "pagina bestand verbinding toegang verzoek fout sida sidan filen anslutning åtkomst begäran fel "
    "strona strony stronę witryna plik pliku serwer adres połączen dostęp konto sesja żądan zasób usługa błąd "
    "sayfa dosya sunucu bağlantı erişim hesap oturum istek içerik hizmet hata adres "
    "страниц сайт файл сервер сервис адрес ссылк аккаунт учетн сесси запрос соединен подключен доступ контент ресурс ошибк служб "
    "сторінк сервер запит помилк доступ صفحة الصفحة الموقع موقع ملف الملف الخادم خادم الرابط الحساب الجلسة الطلب الاتصال الوصول المحتوى خطأ "
    "ページ サイト ファイル サーバ リンク アカウント セッション リクエスト アクセス 接続 エラー コンテンツ サービス 页面 网页 网站 文件 服务器 链接 访问 连接 错误 请求 頁面 檔案 伺服器 페이지 사이트 파일 서버 요청 오류 접근 연결"
    " video folder system operation quota rate computer webserver origin feature profile license subscription password credentials form upload pagina webbplats webbplatsen tjänst tjänsten nettside seite inhalte video kanal profil beitrag bereich subor stránka oldal σελίδα"
    " trial plan fichier vidéo utilisateur utente usuário serwis baza bazą połączenie treść plik sunucuya içerik videoya сервер сайту 動画 画像 アプリ"
    " response attempt name ссылки sesja oturum baglanti лимит الجلسة بيانات 有効期限"
    " webpage archive channel login tab window device component plugin module script path directory memory disk storage object record entry node cluster query cdn ssl tls firewall vpn country region maintenance requête requêtes demande onglet dossier serveurs chaîne cuentas solicitud solicitudes pedido pedidos richiesta richieste verbindungen anfragen ordner kanal profilo cartella canale caminho pasta żądanie żądań kanał folder katalog istek istekler klasör kanal запросов запросы канал папк видео страниц учётн пароль الطلبات القناة الفيديو المجلد الحساب リクエスト チャンネル フォルダ パスワード 動画 通信 频道 视频 账号 网络 系统"
)
#: What is the matter with them.
STATES = (
    "error found notfound fail missing denied deny forbidden unavailable available removed deleted expired suspended blocked banned limit exceed quota timeout timed maintenance down "
    "offline wrong problem broken invalid unauthori disabled unable cannot couldn't could not retry refresh reload exist moved overload terminat restrict permission allow reached reach "
    "refused reset parked unknown unexpected unusual encounter uncaught exception fatal warning misconfig interrupted lost private "
    "gefunden verweigert verboten verfügbar erreichbar gelöscht entfernt abgelaufen gesperrt blockiert überschritten wartung ungültig fehlgeschlagen existiert überlast unterbrochen "
    "introuvable refusé interdit indisponible disponible supprim expir suspendu bloqu dépass maintenance invalide échou existe survenu trouvé réessay joindre "
    "encontrad denegad prohibid disponible eliminad caducad expirad suspendid bloquead superad excedid mantenimiento inválid fallad existe ocurrid inténtelo intente "
    "encontrad negad proibid disponível indisponível removid eliminad expirad suspens bloquead excedid manutenção inválid falh existe ocorreu tente "
    "trovat negat vietat disponibil rimoss eliminat scadut sospes bloccat superat manutenzione valid fallit esiste verificat riprova raggiung "
    "gevonden geweigerd verboden beschikbaar verwijderd verlopen geblokkeerd overschreden onderhoud mislukt hittades nekad tillgänglig förbjuden borttagen spärrad "
    "znalezion odmow zabronion niedostępn dostępn usunięt wygasł zawieszon zablokowan przekroczon konserwac nieprawidłow istnieje wystąpił spróbuj odpowiada "
    "bulunamadı bulunamıyor reddedildi yasak kullanılamıyor kaldırıldı silindi doldu askıya engellendi aşıldı bakım geçersiz başarısız oluştu deneyin ulaşılamıyor "
    "найден запрещ отказан недоступ доступ удален удалён истек истёк заблокирован превышен обслуживан неверн существует произошл повторите попробуйте "
    "знайден заборонен недоступ видален موجودة موجود ممنوع مرفوض متاح متوفر حذف إزالة انتهت محظور تجاوز صيانة حدث فشل "
    "見つかりません 見つかりませんでした 拒否 禁止 利用できません 削除 期限切れ 停止 ブロック 制限 メンテナンス 無効 失敗 発生 存在しません できません 未找到 找不到 拒绝 禁止 不可用 删除 过期 封锁 限制 维护 失败 发生 不存在 無法 찾을 거부 차단 삭제 만료 제한 점검 실패 발생 없습니다"
    " trouble busy respond slow working locked stopped rejected cancelled canceled corrupt damaged empty isn't aren't can't can’t isn’t cannot won't don't doesn't impossible longer specified unreachable inaccessible unresponsive insufficient nonexistent unsupported incorrect conflict automation suspicious crash deactivated closed withdrawn kann konnte können gestört belegt deaktiviert fehlerhaft unbekannt ist unbekannt inaccessible impossible verrouillé fermé suspect puede pudo acceder cerrad incorrect inaccesible imposible possível acessar aceder incorret inacessível impossibile raggiungere inaccessibile scaduta chiuso kunde inte kunde hittas kan laddas stängd kon niet worden bereikt удалось удается удаётся невозможно отсутству прерван закрыт تعذر يتعذر مغلق غير nelze nenalezen nie można nie udało açılamıyor erişilemiyor yapılamıyor"
    " difficult occurred crashed upgrade updating updated visit n'existe n'est répond responde cargar carregar caricare caricamento charg laden geladen wartungsarbeit respond temporair temporär временно chwilowo silinmiş bağlanılamadı bağlanamadı okunamadı yüklenemedi não está respondendo removed removido risponde 無効になっています"
    " authorized valid inactivity violat cannot connect resolution returned failure temporary wygasła süresi doldu oluştu истёк истек срок отключен выключен wyłączony انتهت صلاحية 切れました 切れ"
    " internal many few understood process processed redirect loop refus abort aborted cut dropped hung stuck killed panic halt stopped suspend terminated deprecated obsolete retired discontinued archived unsafe insecure malicious untrusted mismatch malformed duplicate overflow underflow leak null undefined nonexist inexist inaccess incompat unrecogni unresolv unsuccess undeliver unauthent illegal rejected throttl limited ended over broke dead gone trop interne interrompu coupé arrêt annulé fermé désactivé perdu périmé rejeté inconnu dépassé échec impossible erroné illégal plus demasiad interno interrumpid cortad detenid cancelad cerrad desactivad perdid rechazad desconocid fallo imposible erróne ilegal saturad caíd troppi troppe interno interrott fermat annullat chius disattivat pers rifiutat sconosciut impossibil errat inesistent sovraccaric negat demasiad muitos muitas interno interrompid cortad parad cancelad encerrad desativad perdid rejeitad recusad desconhecid impossível inexistente sobrecarreg zu viele interner unterbrochen abgebrochen gestoppt angehalten geschlossen deaktiviert verloren abgelehnt unbekannt unmöglich überlastet ausgefallen beendet zbyt wiele wewnętrzn przerwan zatrzyman anulowan zamknięt wyłączon utracon odrzucon nieznan niemożliw przeciążon zakończon çok fazla kesildi durduruldu iptal kapatıldı kapalı kayboldu bilinmeyen imkansız aşırı sona erdi alındı etkin değil слишком много внутренн прерван остановлен отменён отменен закрыт отключен отключён потерян отклонён отклонен неизвестн невозможн перегружен завершён завершен удалён удален كثيرة انقطع توقف ألغي مغلق معطل فقد غير معروف مستحيل معلق محذوف داخلي 中断 多すぎ キャンセル オフ 閉鎖 失われ 不明 過負荷 不正 内部 超过 过多 中断 取消 关闭 未知 内部 过载 너무 많 중단 취소 종료 내부 정지"
    " trusted unblock verschoben berechtigung unerwartet aufgetreten inattendu droits imprevist inesperad inespéré permiso permisos permissão uprawnień nieoczekiwan izniniz izni beklenmeyen bakımda технически работы прав непредвиденн непредвид الصيانة إذن غير متوقع 権限 予期しない unexpected"
)
#: Scripts.
SCRIPT_WORDS = "javascript js script scripts scripting skript skripte skripten scripts сценари скрипт джаваскрипт جافا سكريبت جافاسكريبت cookies cookie スクリプト 脚本 스크립트 자바스크립트"
#: What has to be done about scripts.
SWITCHES = (
    "enable enabled disabled disable activate turn turned switch switched support required requires require needs need needed allow allowed without blocked start starts work "
    "aktivier eingeschaltet einschalten deaktiviert benötigt erlaub funktioniert erforderlich unterstützt activer activé désactivé nécessit requis autoris exécution "
    "activar active activ habilit desactivad necesit requier debe ative ativar ativ desativad necessári requer permit "
    "abilita abilit attiva disattivat necessari richied consent inschakel vereist nodig aktivera krävs włącz wyłączon wymaga obsług "
    "etkinleştir gerekli gerekiyor devre включите включить отключен требуется необходим разрешите увімкніть تفعيل تمكين مطلوب 有効 無効 必要 启用 禁用 需要 啟用 사용 활성화 필요"
    " necessary functionality works properly must mandatory nécessaire activez désactivez marche funciona funcionar utilizar precisa necessita necesita funzionare funziona serve braucht einzuschalten läuft zulassen werkt nodig måste kräver wymagana potrzebuje çalışması gerekmektedir açın работает работы нужен нужно включить необходимо يتطلب يعمل بحاجة"
    " attiva attivare devez vous devez vous etkin açık kapalı değil habilite ligue ligar turned unlock ative utiliser werken 有効にして 無効になって"
)
#: What else such messages say.
AROUND = (
    "please sorry oops whoops try again later contact administrator webmaster support team home homepage back return continue click here sign login log check minute second hour code detail "
    "message status looking requested request typed currently temporarily owner user this that your with from have been because when while were was will "
    "which some our end there about until into than then what most recent call last line cause reason following before after now too many much "
    "bitte später erneut versuchen noch einmal leider zurück startseite melden anmelden angefordert gewünscht vorübergehend minuten sekunden diese dieser dieses wurde nicht ihre ihren wird sind "
    "veuillez plus tard désolé retour accueil demandé cette votre notre est une nous avez vous pour afficher depuis actuellement "
    "por favor más tarde nuevo vuelva inicio solicitad minutos lo sentimos página ver este esta para que su sus está esté tarde desculpe volte início pedida solicitada mais "
    "per favore più tardi torna richiest minuti spiacenti questa questo visualizzare non è stato stata "
    "probeer later opnieuw deze försök igen senare denna proszę później ponownie przepraszamy wróć żądan aby zobaczyć tej nie tego "
    "lütfen daha sonra tekrar üzgünüz aradığınız devam etmek için bu görmek пожалуйста позже снова извините вернит запрашиваем чтобы эта этой этот для просмотреть увидеть "
    "не найдена будь ласка يرجى المحاولة لاحقا عذرا غير لعرض هذه هذا ください 後でもう一度 申し訳 お探しの 请 稍后 重试 抱歉 您 죄송합니다 다시 나중에"
    " full functionality order using used given address trying having finding taking long believe tools browse access display show view open load loading loaded connect finish complete were their they hmm been sent going gone made here could would should only through under over such more number several other another unless within hours days today diese dieses ihren computer sowie über oder auch haben wenn dies dass eine einen einem cette dans avec sont cela mais pour vous être page que ese esa esto con por los las del una unos no esse essa isso com por dos das uma que se gli della dello delle con che per una det den som för att med till från ett van het een deze voor met naar być może jest przez został została było tym ten ta bir ile olarak veya ya был была было были вами ваш ваша ваше сайта страницы сервера المطلوبة المطلوب هذا إلى من على في"
    " experiencing technical free trying while user owner versuchen einigen minuten cargando usuário usuario utilisateur momentanément właściciela użytkownika przez danych bazą sunucuya временно данный этот ваш この この動画は なって います"
    " internal interno interna interne interner interní internen server wewnętrzny внутренняя внутренний displayed longer terms login merci navigateur браузере браузер действия returned name twoja danych قاعدة"
    " wasn't wasn’t couldn't couldn’t process secure internet load open properly again ever very being made content payment"
    " moderators item used unless media either format kein keine haben producido produit était ведутся просмотра görüntüleme ليس لديك للوصول ただいま"
)
#: Dummy text: words that say that a text is one, and words that go with them.
DUMMY_WORDS = (
    "placeholder dummy sample example filler temporary lorem ipsum temp testing blank replace "
    "platzhalter blindtext beispiel muster mustertext factice exemple remplissage provisoire ejemplo relleno prueba muestra ficticio "
    "exemplo preenchimento amostra fictício segnaposto esempio riempimento prova finto voorbeeld tijdelijke platshållare exempel "
    "przykład zastępcz próbn tymczasow örnek geçici deneme yer tutucu пример образец заполнитель тестов временн приклад تجريبي نموذج مثال ダミー サンプル 仮 例文 入力 示例 占位 测试 예시 샘플"
)
DUMMY_AROUND = (
    "text line subtitle caption cue number title word sentence second first third only here fill space type insert write enter your goes translate this will before another more row entry "
    "zeile text untertitel hier steht satz nummer ihr ihre texte ligne sous titre votre numéro phrase ici texto línea subtítulo escriba aquí número frase su linha legenda escreva aqui sua seu "
    "testo riga sottotitolo qui scrivi tuo frase regel ondertitel hier tekst napis linia wiersz tutaj metin satır altyazı buraya yazın строка текст субтитр здесь введите ваш рядок نص سطر ترجمة هنا 字幕 テキスト ここに 行 文字 文本 此处 자막 여기"
)


# --- Letters ----------------------------------------------------------------------------------------------------------
class _Letters(dict):
    """A table for translate: folded letters; what is no letter is dropped."""

    def __missing__(self, code: int) -> str | None:
        out = self[code] = chr(code) if chr(code).isalpha() else None
        return out


_FOLD = _Letters(str.maketrans({
    "0": "o", "1": "l", "i": "l", "|": "l", "!": "l", "ı": "l", "5": "s", "$": "s", "@": "a", "4": "a", "3": "c", "e": "c", "8": "b",
    "t": "f", "7": "f", "6": "g", "9": "g", "q": "g",
}))
#: The same for ASCII, small letters and capitals, as bytes: what each becomes, and what is dropped.
_ASCII = bytes(ord(chr(k).casefold().translate(_FOLD) or "-") for k in range(128)) + bytes(range(128, 256))
_DROPPED = bytes(k for k in range(128) if not chr(k).casefold().translate(_FOLD))
_IDS = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{4,}\b|\d{2,}", re.IGNORECASE)
_DIGIT = re.compile(r"\d")
GRAM = 5


def fold(text: str) -> str:
    """Letters only, without what character recognition and encodings confuse or spoil."""
    if text.isascii():
        text = text.encode().translate(_ASCII, _DROPPED).decode()
    else:
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text)).casefold().translate(_FOLD)
    return text.replace("vv", "w").replace("rn", "m").replace("cl", "d")


def skeleton(text: str) -> str:
    """Folded letters of a text without its numbers and ids."""
    return fold(_IDS.sub(" ", text) if _DIGIT.search(text) else text)


def misread(text: str) -> list[str]:
    """How a text looks whose one-byte encoding was taken for another; UTF-8 is set right by repair."""
    if text.isascii():
        return []
    return [text.encode(used, "ignore").decode("cp1252", "ignore") for used in ("cp1250", "cp1251", "cp1254", "cp1256", "koi8-r")] + [
        text.encode("ascii", "ignore").decode()
    ]


# --- Lexicon ----------------------------------------------------------------------------------------------------------
THING, STATE, SCRIPT, SWITCH, SAID, DUMMY, GOES = 1, 2, 4, 8, 16, 32, 64
MESSAGE_WORDS, DUMMY_TEXT = THING | STATE | SCRIPT | SWITCH | SAID, DUMMY | GOES
#: A unit is a message from this share of the letters of its words of weight on; less will do where it stands alone in a text's place.
KNOWN_WORDS, KNOWN_ALONE = 0.72, 0.5
_ASIAN = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
_ASIAN_RUN = re.compile(r"[぀-ヿ㐀-鿿가-힯々ー]+|[^\W_぀-ヿ㐀-鿿가-힯々ー]+")
_TOKEN = re.compile(r"[^\W_]+(?:['’`][^\W_]+)*")
_WORD = re.compile(r"[^\W_]+[;]?")
#: Words that lie along a row of keys, either way.
TYPED = frozenset(w for row in ROWS for way in (row, row[::-1]) for a in range(len(row)) for z in range(a + 3, len(row) + 1) if (w := way[a:z]))
#: What follows a point within an address.
_ADDRESS = re.compile(r"(?:(?<=\S)\.(?=\S)|\s\.\s|\W?\bdot\b\W?\s?)\w+")

#: Words that negate; by themselves they tell no state.
NEGATIONS = (
    "not no wasn't wasn’t couldn't couldn’t plus don't doesn't won't isn't aren't can't can’t isn’t cannot could couldn't kann konnte können nicht ist est una que não está kan kunde inte kon niet worden nie można не غير حدث"
)


#: What is counted in a text, in one number: so many bits for each count, and the words' hashes above them.
_COUNTS = ("weight", "said", "dummy", "latin", "typed", "words", "things", "states", "scripts", "switches", "dummies")
_BITS = 24
_MASK = (1 << _BITS) - 1
_AT = {name: _BITS * k for k, name in enumerate(_COUNTS)}
_HASHES = _BITS * len(_COUNTS)
#: Where counts must be above zero for a message, and for dummy text of any kind.
_ABOUT = _MASK << _AT["things"] | _MASK << _AT["scripts"]
_DUMMY_SOMEHOW = _MASK << _AT["latin"] | _MASK << _AT["typed"] | _MASK << _AT["dummies"]


def counted(told: int, name: str) -> int:
    return told >> _AT[name] & _MASK


def _hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word) & 0xFFFFF


class Lexicon(dict):
    """Counts what a token tells, by the beginnings of its words; short entries must be whole words. Answers are remembered."""

    LARGEST = 500_000

    def __init__(self) -> None:
        super().__init__()
        self.stems: dict[str, int] = {}
        self.asian: dict[str, int] = {}
        for words, what in ((THINGS, THING), (STATES, STATE), (SCRIPT_WORDS, SCRIPT), (SWITCHES, SWITCH), (AROUND, SAID), (DUMMY_WORDS, DUMMY), (DUMMY_AROUND, GOES)):
            for w in words.split():
                if _ASIAN.search(w):
                    self.asian[w] = self.asian.get(w, 0) | what
                else:
                    s = fold(w)
                    self.stems[s] = self.stems.get(s, 0) | what
        for w in NEGATIONS.split():
            self.stems[fold(w)] = SAID
        self.longest = max(map(len, self.stems))

    def word(self, word: str) -> tuple[int, int]:
        """(what a word tells, its letters of weight)."""
        s = fold(word)
        out = self.stems.get(s, 0)
        for k in range(5, min(len(s), self.longest + 1)):
            out |= self.stems.get(s[:k], 0)
        return out, len(s) if len(s) >= 4 or out else 0

    def _parts(self, token: str) -> Iterator[tuple[int, int, int, int]]:
        """(what it tells, letters of weight, of these known to messages, known to dummy text) of a token's words."""
        for w in _TOKEN.findall(token):
            if w.isascii() or not _ASIAN.search(w):
                what, n = self.word(w)
                yield what, n, n if what & MESSAGE_WORDS else 0, n if what & DUMMY_TEXT else 0
                continue
            for run in _ASIAN_RUN.findall(w):
                if not _ASIAN.match(run):
                    what, n = self.word(run)
                    yield what, n, n if what & MESSAGE_WORDS else 0, n if what & DUMMY_TEXT else 0
                    continue
                told = said = dummy = 0
                for stem, what in self.asian.items():
                    if stem in run:
                        told |= what
                        said += len(stem) if what & MESSAGE_WORDS else 0
                        dummy += len(stem) if what & DUMMY_TEXT else 0
                # Endings of Japanese and Korean words are not listed: half of the letters will do.
                yield told, len(run), min(len(run), 2 * said), min(len(run), 2 * dummy)

    def __missing__(self, token: str) -> int:
        if len(self) >= self.LARGEST:
            self.clear()
        counts = dict.fromkeys(_COUNTS, 0)
        for what, n, said, dummy in self._parts(token):
            counts["weight"] += n
            counts["said"] += said
            counts["dummy"] += dummy
            for bit, name in ((THING, "things"), (STATE, "states"), (SCRIPT, "scripts"), (SWITCH, "switches"), (DUMMY, "dummies")):
                counts[name] += bool(what & bit)
        if counts["dummies"] and _ADDRESS.search(token):
            counts["dummies"] = 0
        words = _WORD.findall(token.lower())
        counts["words"] = len(words)
        counts["latin"] = sum(w in LATIN for w in words)
        counts["typed"] = sum(w in TYPED for w in words)
        found = sum(min(n, _MASK) << _AT[name] for name, n in counts.items()) + (sum(map(_hash, words)) << _HASHES)
        if len(token) <= 64:
            self[token] = found
        return found

    def weigh(self, text: str) -> int:
        """All counts of a text, in one number."""
        return sum(map(self.__getitem__, text.split()))


LEXICON = Lexicon()
_SPACED = re.compile(r"(?<!\S)(\S)[^\S\n](?=\S(?!\S))")


def joined(text: str) -> str:
    """The text with letters that stand apart put together again."""
    tokens = text.split()
    if len(tokens) >= 8 and 2 * sum(len(t) == 1 for t in tokens) > 1.5 * len(tokens):
        return _SPACED.sub(r"\1", text)
    return text


def says_failure(told: int, text: str) -> float:
    """The share of letters of weight that belong to messages, if the words tell that something failed, or that scripts are required; else 0."""
    if not told & _ABOUT:
        return 0.0
    about = (counted(told, "things") and counted(told, "states")) or (counted(told, "scripts") and (counted(told, "switches") or counted(told, "states")))
    if not about or counted(told, "weight") < 8 or text.rstrip().endswith(("?", "？", "؟")):
        return 0.0
    return counted(told, "said") / counted(told, "weight")


def says_dummy(told: int, text: str) -> bool:
    """Whether the words say that this is dummy text; the ends of addresses (".example") don't count."""
    if not counted(told, "dummies"):
        return False
    if _ADDRESS.search(text):
        told = LEXICON.weigh(_ADDRESS.sub(" ", text))
    return bool(counted(told, "dummies")) and counted(told, "dummy") >= KNOWN_WORDS * counted(told, "weight")


# --- Phrases ----------------------------------------------------------------------------------------------------------
#: The share of a known phrase's sequences that must be there, and of a unit's letters that must be covered.
FOUND, COVER = 0.4, 0.72
#: Percent of a unit's letters after which it is given up, if they leave more uncovered than COVER allows for all.
PART = 55
#: Letters from which on a unit is compared with phrases.
LETTERS = 9


class Phrases:
    """Known texts, by the short letter sequences of their skeletons."""

    def __init__(self, texts: Iterable[str]) -> None:
        forms = {s: None for t in texts for f in (t, *misread(t)) if len(s := skeleton(f)) >= GRAM}
        self.grams = [frozenset(s[k : k + GRAM] for k in range(len(s) - GRAM + 1)) for s in forms]
        self.where: dict[str, list[int]] = {}
        for k, own in enumerate(self.grams):
            for g in own:
                self.where.setdefault(g, []).append(k)
        self.known = frozenset(self.where)

    def covered(self, own: list[str], n: int, grams: set[str]) -> float:
        """The share of n letters, whose sequences are given (in order, and as a set), that lie in sequences of texts that are mostly there."""
        there_at_all = self.known & grams
        if 2 * len(there_at_all) < FOUND * len(grams):
            return 0.0
        hits = Counter(k for g in there_at_all for k in self.where[g])
        there = [self.grams[k] for k, c in hits.items() if c >= FOUND * len(self.grams[k])]
        upto = total = 0
        for k, g in enumerate(own):
            if g in there_at_all and any(g in grams for grams in there):
                total += k + GRAM - max(upto, k)
                upto = k + GRAM
        return total / n


_STATUS_LINE = re.compile(r"(?i)^\W*(?:http\S{0,6}|error|err0r)?\W*[1-5lso]\w{2}\b\W*(.{3,40}?)\W*$")
#: How a page's or a service's answer begins; its texts stand between tags, or after names.
MARKUP = re.compile(r"(?i)^\W*(?:<\W{0,2}(?:html|!?doctype|.?xml|error|title|div|body|noscript|n0script)\b|\{\s?[\"'`”“?�\u0080-\u009f]{1,3}\w+\W{0,3}:)")
BETWEEN = re.compile(r"<[^<>]{0,200}>|\W{0,3}\w+[\"”“?�\u0080-\u009f]{0,3}\s?:\s?(?=[\"”“?�\u0080-\u009f{\w])|[\n{}\"”“]")
_TAG = re.compile(r"<[^<>\n]{0,200}>")
_CODES = re.compile(r"\{[\\yY][^{}]*\}")


def letters(unit: str) -> str:
    """What a unit says: without markup and codes."""
    if "{" in unit:
        unit = _CODES.sub(" ", unit)
    return _TAG.sub(" ", unit) if "<" in unit else unit


class Judge:
    """Judges units by the public lists and by what was learnt from a corpus: messages, and dummy captions."""

    #: Units whose verdict is remembered.
    LARGEST = 200_000

    def __init__(self, messages: Iterable[str] = (), captions: Iterable[str] = ()) -> None:
        self.pages = Phrases((*STATUS, *MESSAGES, *SCRIPTS, *messages))
        self.dummies = Phrases(captions)
        self.known = self.pages.known | self.dummies.known
        self.short = frozenset(map(skeleton, (*STATUS, "Loading...", *messages)))
        self.seen: dict[str, tuple[float, bool]] = {}

    def look(self, unit: str) -> tuple[float, bool]:
        """(how surely the unit is nothing but a message, whether it is filler)."""
        found = self.seen.get(unit)
        if found is None:
            if len(self.seen) >= self.LARGEST:
                self.seen.clear()
            body = letters(unit).strip()
            skel = skeleton(body)
            told = LEXICON.weigh(body)
            pages = dummies = 0.0
            own = self._sequences(skel)
            if own and 2 * len(self.known & (grams := set(own))) >= FOUND * len(grams):
                pages, dummies = self.pages.covered(own, len(skel), grams), self.dummies.covered(own, len(skel), grams)
            found = (self._message(unit, body, skel, pages, told), dummies >= COVER or self._filler(body, told))
            if len(unit) <= 1000:
                self.seen[unit] = found
        return found

    def _sequences(self, skel: str) -> list[str]:
        """All letter sequences in order; none if those of the first part leave too many letters uncovered, whatever follows."""
        n, part = len(skel), len(skel) * PART // 100
        own = [skel[k : k + GRAM] for k in range(min(part, n - GRAM + 1))]
        if part - GRAM * sum(map(self.known.__contains__, own)) > (1 - COVER) * n + 1:
            return []
        return own + [skel[k : k + GRAM] for k in range(len(own), n - GRAM + 1)]

    def message(self, unit: str) -> bool:
        return self.look(unit)[0] >= KNOWN_WORDS

    def message_alone(self, unit: str) -> bool:
        """Whether the unit is a message, given that it stands where a page would stand."""
        return self.look(unit)[0] >= KNOWN_ALONE

    def filler(self, unit: str) -> bool:
        return self.look(unit)[1]

    def _message(self, unit: str, body: str, skel: str, covered: float, told: int) -> float:
        if skel in self.short:
            return float(bool(skel))
        if len(skel) >= LETTERS and covered >= COVER:
            return 1.0
        if len(body) <= 100 and (m := _STATUS_LINE.match(body)) and skeleton(m.group(1)) in self.short:
            return 1.0
        if ("<" in unit or "{" in unit) and MARKUP.match(unit):
            return max((self.look(part)[0] for part in BETWEEN.split(unit) if len(part) > 3 and part != unit), default=0.0)
        if len(skel) < GRAM:
            return 0.0
        if len(body) < 3 * body.count(" ") and (again := joined(body)) != body:
            told = LEXICON.weigh(again)
        return says_failure(told, body)

    def _filler(self, text: str, told: int) -> bool:
        """What says that it is dummy text, dummy Latin, keyboard noise, or one word again and again."""
        n = counted(told, "words")
        if not n:
            return False
        somehow = told & _DUMMY_SOMEHOW
        if somehow and (counted(told, "latin") >= 0.6 * n or counted(told, "typed") >= 0.6 * n):
            return True
        if n >= 2 and (told >> _HASHES) % n == 0 and len(set(_WORD.findall(text.lower()))) == 1 and not text.startswith(("[", "(", "*", "#", "♪")):
            return True
        return bool(somehow) and says_dummy(told, text)
