"""Fixed values of the message rules: word lists, patterns and weights that results depend on."""

SHORTENERS = ("bit.ly", "tinyurl.com", "t.co", "rb.gy")
BRANDS = ("microsoft", "paypal", "apple", "google", "amazon", "bankofamerica", "chase", "dhl")
BRAND_HINTS = ("microsoft", "paypal", "apple", "google", "amazon", "bank", "dhl")
RISKY_TLDS = (".xyz", ".top", ".click", ".work", ".country", ".gq", ".tk")
DOMAIN_TOKENS = ("secure", "verify", "login", "update", "account", "wallet", "payment", "billing", "invoice", "finance", "portal", "support")
URL_TOKENS = ("verify", "secure", "login", "account", "update", "password")
LOGIN_TOKENS = ("/verify", "/login", "/account", "/secure", "/payment", "/billing", "/portal", "confirm")

URGENCY = (
    r"\baction required\b",
    r"\bwithin (?:the )?next \d+\s*(?:hours?|days?)\b",
    r"\bimmediately\b",
    r"\basap\b",
    r"\bfinal notice\b",
    r"\btemporary hold\b",
    r"\bservice interruption\b",
)
THREAT = (
    r"\baccount (?:locked|suspended|disabled)\b",
    r"\baccount (?:termination|terminated|closure|closed)\b",
    r"\baccount (?:has been )?[li]imited\b",
    r"\bemail account (?:has been )?limited\b",
    r"\b[li]imited access\b",
    r"\b(?:will be )?(?:shut ?down|disabled|terminated)\b",
    r"\bsecurity alert\b",
    r"\bunauthorized\b",
    r"\bcompromised\b",
    r"\bviolation detected\b",
)
PAYMENT = (r"\bpayment\b", r"\bgift\s?card\b", r"\binvoice\b", r"\bwire transfer\b")
CREDENTIAL = (
    r"\blog(?:-| )?in\b",
    r"\bpassword\b",
    r"\bverify (?:your )?(?:account|identity|credentials)\b",
    r"\b(?:account|email|mailbox) verification\b",
    r"\b(?:confirm|comfirm) (?:your )?(?:account|identity|information|credentials)\b",
    r"\b(?:activate|reactivate|upgrade) (?:your )?(?:account|mailbox)\b",
    r"\bmfa\b",
)
ACTION = (
    r"\bclick\b",
    r"\bvisit\b",
    r"\bopen\b",
    r"\b(?:confirm|comfirm|verify|activate|reactivate|upgrade)\b",
    r"\bplease contact (?:your )?(?:helpdesk|it support)\b",
)
TAKEOVER = (
    r"\baccount (?:has been )?(?:limited|locked|suspended|disabled|terminated)\b",
    r"\b(?:verify|confirm|comfirm|update|activate|reactivate|upgrade) (?:your )?(?:account|email|mailbox|identity|information|credentials)\b",
    r"\b(?:account|email|mailbox) (?:verification|activation|upgrade)\b",
    r"\b(?:email )?account (?:will be )?(?:shut ?down|closed|terminated|limited)\b",
)
KEYWORDS = (
    "verify your account",
    "account verification",
    "confirm your account",
    "comfirm your account",
    "account information",
    "account has been limited",
    "action required",
    "suspicious activity",
    "limited access",
    "iimited access",
    "account termination",
    "termination notice",
    "security alert",
    "violation detected",
    "email account has been limited",
    "pending message",
    "important upgrade",
    "activate your account",
    "account activation",
    "helpdesk",
    "docusign account",
)
SUBJECT_ACTIONS = (
    "verify",
    "verification",
    "confirm",
    "comfirm",
    "activate",
    "activation",
    "upgrade",
    "limited",
    "iimited",
    "suspend",
    "termination",
    "shut down",
    "security",
    "violation",
)
SUBJECT_ACCOUNTS = ("account", "email", "mailbox")
SUBJECT_BRANDS = ("microsoft", "paypal", "docusign", "usaa", "bank", "dhl", "helpdesk")
IMPERSONATION = (("it support", "IT support"), ("helpdesk", "IT support"), ("hr", "HR"), ("bank", "Bank"), ("finance", "Finance"), ("microsoft", "Microsoft"), ("paypal", "PayPal"))
PHISHING_WORDS = ("verify", "password", "urgent", "invoice", "wire transfer")

PROMO = (
    "unsubscribe",
    "newsletter",
    "limited time offer",
    "special offer",
    "buy now",
    "free trial",
    "winner",
    "congratulations",
    "promo code",
    "discount",
    "sale",
    "earn money",
    "work from home",
    "crypto giveaway",
)
PROMO_PATTERNS = (r"\bclick here\b", r"\bshop now\b", r"\bclaim (?:your )?(?:offer|reward|prize)\b", r"\bsubscribe\b")

ROUTER_TOKENS = ("verify", "password", "urgent", "invoice", "wire transfer", "login", "security alert", "account locked", "suspended", "mfa", "gift card")
ROUTER_URGENCY = ("urgent", "immediately", "asap", "expires", "within 24 hours", "final notice", "action required", "suspended")
ROUTER_ACTIONS = (r"\bverify (?:your )?(?:account|identity|credentials)\b", r"\breset (?:your )?password\b", r"\b(?:click|open|download)\b", r"\blog(?:-| )?in\b")

EXECUTABLES = (".exe", ".msi", ".bat", ".cmd", ".scr", ".js", ".vbs", ".jar", ".ps1", ".hta", ".iso")
ARCHIVES = (".zip", ".rar", ".7z", ".tar", ".gz", ".bz2")
HIGH_RISK = (*EXECUTABLES, ".zip", ".rar")
MACROS = (".docm", ".xlsm", ".pptm")
EXPECTED_SUFFIXES = {
    "pdf": (".pdf",),
    "zip": (".zip", ".docx", ".xlsx", ".pptx"),
    "ole": (".doc", ".xls", ".ppt"),
    "html": (".htm", ".html"),
    "image": (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp"),
    "audio": (".wav", ".mp3", ".m4a", ".ogg", ".flac"),
}
MIME_TYPES = {
    ".pdf": "application/pdf", ".zip": "application/zip", ".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".ppt": "application/vnd.ms-powerpoint", ".htm": "text/html", ".html": "text/html",
    ".txt": "text/plain", ".csv": "text/csv", ".xml": "text/xml", ".json": "application/json", ".js": "text/javascript", ".exe": "application/octet-stream", ".tar": "application/x-tar",
    ".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".wav": "audio/x-wav", ".mp3": "audio/mpeg", ".eml": "message/rfc822",
}
IMAGE_NAME_HINTS = ("invoice", "login", "verify", "qr", "payment", "account", "microsoft", "bank")
IMAGE_TEXT_HINTS = ("password", "verify", "urgent", "scan qr", "login", "account suspended")
IMAGE_BRANDS = ("microsoft", "paypal", "apple", "google", "bank")
AUDIO_NAME_HINTS = ("ceo", "urgent", "wire", "transfer", "payment", "invoice")
AUDIO_TEXT_HINTS = ("wire transfer", "urgent", "immediately", "confidential", "don't call", "payment today")

HTML_KEYWORDS = ("verify account", "password", "urgent", "suspended", "security check", "wallet", "invoice", "mfa")
HTML_BRANDS = ("microsoft", "paypal", "apple", "google", "dhl", "amazon", "bank")
TOKEN_KEYS = ("token", "code", "auth", "authorization", "session", "key", "apikey", "access_token", "id_token", "refresh_token", "cookie", "sig", "signature")

#: Most items a path shows of each kind; absent: none.
BUDGETS = {
    "FAST": {"url_signals": 2, "attachment_signals": 1, "domain_reports": 2, "highlights": 2},
    "STANDARD": {"url_signals": 4, "attachment_signals": 2, "domain_reports": 3, "web_signals": 2, "highlights": 3},
    "DEEP": {"url_signals": 6, "attachment_signals": 4, "domain_reports": 5, "web_signals": 4, "attachment_reports": 4, "url_target_reports": 4, "highlights": 4},
}
