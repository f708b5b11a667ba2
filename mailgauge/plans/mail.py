"""Messages made from ``documents`` with invented injections, by one SQL text for Spark and DuckDB alike.

The documents' whole texts are kept; phrases, links, senders, results and file names are added by the
document's number, as the corpus itself has none of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Invented injections, dealt by doc_id modulo their number.
SUBJECTS = (
    "Notice", "Action required: verify your account!!", "Weekly newsletter", "Pending message from helpdesk", "Invoice reminder",
    "PayPal account limited", "Lunch on Friday", "Email account termination",
)
PHRASES = (
    "", "Please click to verify your account within the next 24 hours.\t\r", "The attached invoice is due, open it immediately.",
    "Your account has been limited. Confirm your identity and password.", "Special offer: buy now, 50 discount, click here to unsubscribe!!!",
    "Final notice: unauthorized log-in, security alert. Upgrade your mailbox.", "See you at the meeting tomorrow.",
)
LINKS = (
    "", "https://bit.ly/reset", "https://www.example.org/news?page=2&ref=x", "http://secure-login-paypa1-update.xyz/verify?id=7",
    "https://xn--pple-43d.com/account", "https://MICROSOFT-support.top/Portal;v=1?x=1#top and http://10.1.2.3/login", "https://paypal-billing.com/confirm?token=abcdef",
    "https://docs.example.net/a_b/c?u=https%3A%2F%2Fevil.example%2Fx and https://rb.gy/z and https://docs.example.net/a_b/c?u=https%3A%2F%2Fevil.example%2Fx",
    "http://user@chase9.com:8080/path", "https://docs.example.net/q?u=a+b%20c%2B*~&email=jo.hn%40example.org&empty=&flag&token=%41bc&long=%E2%82%AC%E2%82%AC%E2%82%ACabcdefghijklmnopqrstuvwxyz&bad=100%",
    "https://tracker.example.com/?r=aHR0cHM6Ly9ldmlsLmNvbS9sb2dpbg==&s=PGh0bWw-PGI-eG48L2I-aGVsbG8", "https://a.example/?x=%2568ttps%253A%252F%252Fdeep.example%252Fa&y=%26%23104%3Bttp%26colon%3B%2F%2Fent.example%2Fb&z=a%26amp%3Bb",
    "https://b.example/?" + "&".join(f"u{i}=http%3A%2F%2Fn{i}.example%2F" for i in range(10)), "https://c.example/?" + "&".join(f"p{i}=1" for i in range(31)) + "&q=%41", "https://d.example/?v=" + "a+" * 400 + "http://cut.example",
)
SENDERS = ("Team <news@example.org>", "IT support <help@micros0ft.com>", "Bank <alert@bank.example>")
REPLIES = ("", "news@example.org", "reply@other.example", "help@micros0ft.com", "x@mail.example.net")
AUTHS = ("spf=pass dkim=pass dmarc=pass p=none", "spf=fail smtp.mailfrom=a@evil.example dkim=none dmarc=fail p=reject", "spf=softfail dkim=fail d=evil.example", "", "spf=pass; spf=fail dkim = pass")
RECEIVED = ("Received: from mx.example.org", "Received: from 10.0.0.8 by mx", "Subject: x", "", "Received: from localhost by mx", "X-Note: a\n Received: from 10.2.2.2 folded")
FILES = ("", "invoice.pdf", "setup.exe", "report.docm", "photos.zip", "a.tar.gz", "notes.txt", "scan.JS", "budget.xlsm", "README", ".zip")


def _pick(values: tuple[str, ...], number: str = "doc_id", of: int = 0) -> str:
    """One value by the number modulo ``of``, or else their count; past the last value, the first."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {number} % {max(of, len(values))} {cases} ELSE '{values[0]}' END"


def _or_null(value: str, every: int) -> str:
    """``value``, or null in one of ``every`` rows."""
    return f"CASE WHEN doc_id % {every} <> 3 THEN {value} END"


MAIL_SQL = f"""
SELECT doc_id AS email_id, {_or_null(_pick(SUBJECTS, of=11), 31)} AS subject,
       {_or_null(f"coalesce(text, '') || '. ' || {_pick(PHRASES, of=23)} || ' ' || {_pick(LINKS, of=19)}", 83)} AS text,
       {_or_null(_pick(SENDERS), 37)} AS sender, {_or_null(_pick(REPLIES, of=7), 41)} AS reply_to, {_or_null(_pick(AUTHS, of=13), 43)} AS auth,
       {_or_null(_pick(RECEIVED, of=17), 47)} AS received, {_or_null(_pick(FILES, of=29), 53)} AS attachment
FROM documents
"""

FORMS = (
    "", '<form action="/go"><input type="password" name="pw"></form>', '<iframe src="x"></iframe><p>verify account PayPal wallet</p>', '<meta http-equiv="refresh" content="0;url=x"><input name="otp_code">',
    '<form><input type="text"></form><script src="https://cdn.example/x.js"></script> Microsoft password', '<a href="https://evil.example/a">https://bank.example/login</a>', '<img src="data:text/plain;base64,aGVsbG8=">',
)
PAGES_SQL = f"SELECT page_id, url, html || ' ' || {_pick(FORMS, 'page_id')} AS html FROM pages"

#: Invented attachments; three documents in a row make the attachments of one message.
NAMES = ("invoice.pdf", "macro.doc", "notes.txt", "login-bank.png", "ceo-wire.mp3", "setup.exe", "report.docm", "", "dir/payment.dat", "verify.xls", "fake.PDF", "  ")
HEADS = ("%PDF-1.4 /JavaScript /AcroForm ", "VBA project ", "%PDF-1.7 ", "")
READ = ("", "Scan QR and verify your password at Microsoft", "Account suspended, urgent")
HEARD = ("", "An URGENT wire transfer, confidential", "payment today")
MAIL_FILES_SQL = f"""
SELECT doc_id // 3 AS email_id, doc_id % 3 AS pos, {_pick(NAMES)} AS name,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE {_pick(HEADS)} || coalesce(text, '') || ' ' || {_pick(LINKS, of=13)} END AS content,
       {_pick(READ)} AS ocr_text, CASE WHEN doc_id % 7 = 0 THEN 'https://qr.example/x' ELSE '' END AS qr_url, {_pick(HEARD, of=5)} AS transcript
FROM documents
"""
#: Raw requests, some of which are refused.
REQUESTS = (
    "hello", '{"text": "x", "eml_path": "/etc/mail"}', '{"text": "x", "attachments": [{"name": "a.pdf"}, {"filename": "b.txt"}]}', '{"attachments": [{"name": "ok.txt"}, {"name": "../a.txt"}]}', '{"attachments": "a.pdf"}',
    '{"attachments": [1]}', '{"attachments": [{"name": 3, "filename": "ok.txt"}]}', '{"attachments": [{"filename": " "}, {"name": "/x"}]}', "{broken}", '{"eml_path": " ", "attachments": null}', '[{"eml_path": "x"}]', '{"eml_path": 7}',
)
REQUESTS_SQL = f"SELECT doc_id, {_pick(REQUESTS)} AS raw FROM documents"
#: Members of JSON messages besides the text, some of another type than theirs.
MEMBERS = (
    '"subject": " Order ", "attachments": ["a.pdf", " a.pdf ", {"name": "b.doc"}, {"filename": "c.js"}, 7]', '"subject": 5, "attachments": "a.pdf", "urls": ["https://json.example/u", " ", 3, null]', '"to": ["x@a.example", " x@a.example", 4], "cc": "none", "sender": "s@b.example "',
    '"headers": {"X-B": "2", "a": "1", "x-b": "3", "n": 5, "t": true}, "attachments": [{"name": "", "filename": "d.zip"}, {"name": 0}, [], null]', '"url_signals": [{"risk_flags": ["a", "b"]}, {"url": "u"}], "nlp": {"urgency": 0.5, "deep": [[1], 2]}', '"body_text": "see http://b.example/ now", "date": " d ", "attachments": {"name": "x"}', '"reply_to": "", "subject": "", "urls": {}',
)
#: Paths that are looked up in them.
PATHS = ("url_signals[0].risk_flags", "url_signals[0].risk_flags[1]", "url_signals[1].url", "nlp.urgency", "nlp.deep[0]", "attachments[0].filename", "attachments[2].name", "subject", "urls[3]", "no.such[0]", "bad path", "nlp..deep")


def json_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(email_id, raw): JSON messages of whole documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    members = _pick(MEMBERS).replace("{", "{{").replace("}", "}}")
    whole = "to_json(named_struct('text', coalesce(text, '')))"
    return spark.sql(f"SELECT doc_id AS email_id, concat(substr({whole}, 1, length({whole}) - 1), ', ', {members}, '}}}}') AS raw FROM {{docs}}", docs=docs)


JSON_MAIL_SQL = f"SELECT doc_id AS email_id, (left(to_json(struct_pack(text := coalesce(text, '')))::VARCHAR, -1) || ', ' || {_pick(MEMBERS)} || '}}')::JSON AS j FROM documents"
#: Invented settings of profiles, some of which aren't whole numbers over 0.
SETTINGS = (
    ("strict", "review", "20"), ("strict", "deep", "40"), ("strict", "url_weight", " 34 "), ("strict", "suspicious_min", "15"), ("strict", "suspicious_max", "19"),
    ("lenient", "review", "50"), ("lenient", "url_weight", "-3"), ("lenient", "suspicious_min", "45"), ("lenient", "suspicious_max", "49"), ("lenient", "deep", "many"), ("lenient", "colour", "7"), (None, "deep", "65"), (None, "review", "0"),
)
#: Labels as data sets write them.
LABELS = ("Phishing", " 1.0 ", "legit", "Safe Email", "phishing-email", "non phishing email", "maybe", "", "SPAM!", "0", "unsafe", "true")
#: Pages as if fetched before, by their canonical URL.
FETCHED = (
    ("https://bit.ly/reset", '<title>Sign in</title><form action="/go"><input type="password" name="pw"></form> Microsoft password'),
    ("http://secure-login-paypa1-update.xyz/verify?id=7", '<form><input type="password"><input name="otp_code"></form> PayPal: verify account, suspended'),
    ("https://www.example.org/news?page=2&ref=x", "<p>News of the week</p>"),
    ("https://paypal-billing.com/confirm?token=abcdef", '<iframe src="x"></iframe><form></form> invoice'),
)


def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(MAIL_FILES_SQL.replace("FROM documents", "FROM {docs}").replace("doc_id // 3", "doc_id div 3"), docs=docs.select("doc_id", "text"))


#: Hosts whose addresses a fetch must or must not reach.
HOSTS = (
    "[::ffff:7f00:1]", "[::127.0.0.1]", "[64:ff9b::7f00:1]", "[2002:7f00:1::]:8080", "[2001::1]", "[::2]", "[2606:4700::1111]", "[2001:4860:4860:0:0:0:0:8888]", "127.1", "2130706433", "0x7f.0.0.1", "0177.0.0.1", "8.8.8.8", "134744072",
    "localhost", "x.localhost:80", "192.0.0.9", "192.0.0.8", "[fe80::1%25eth0]", "[2001:db8::1]", "u@[::1]", "[1::2::3]", "1.2.3.4.5", "300.1.1.1", "[ff02::1]", "example.org", "[2001:20::1]",
)
TARGETS_SQL = f"SELECT doc_id AS email_id, -1 AS pos, 'http://' || {_pick(HOSTS)} || '/' AS url FROM documents"


def fetch_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(TARGETS_SQL.replace("FROM documents", "FROM {docs}"), docs=docs.select("doc_id"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(REQUESTS_SQL.replace("{", "{{").replace("}", "}}").replace("FROM documents", "FROM {docs}"), docs=docs.select("doc_id"))


def mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spark.sql(MAIL_SQL.replace("FROM documents", "FROM {docs}"), docs=docs.select("doc_id", "text"))


def mail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return spark.sql(PAGES_SQL.replace("FROM pages", "FROM {pages}"), pages=pages.select("page_id", "url", "html"))
