"""Word lists, lookup tables, constants and patterns the results depend on."""

# --- fixed values: URL and text vocabularies ---------------------------------------------------

HOMOGRAPH_CHARACTERS = ["0", "1", "@", "3", "5", "!", "4"]

URL_SHORTENER_PATTERN = r"(bit\.ly|goo\.gl|tinyurl|short\.link|ow\.ly)"

SUSPICIOUS_TLDS = [".tk", ".ml", ".ga", ".cf", ".gq", ".xyz", ".top", ".click"]

PHISHING_KEYWORDS = [
    "login", "signin", "account", "verify", "update", "secure",
    "banking", "paypal", "ebay", "amazon", "apple", "microsoft",
    "password", "suspended", "locked", "confirm", "urgent",
]

URGENCY_TERMS = [
    "urgent", "immediate", "expire", "suspend", "deadline", "limited time", "act now", "hurry", "quick", "fast",
    "عاجل", "هام", "مهم", "فوري", "تنبيه", "انتهت", "انتهاء", "مطلوب فوراً", "تحقق الآن", "تحديث", "تأكيد",
    "استعادة", "حسابك", "كلمة المرور",
]

PERSONALIZATION_PATTERNS = [
    r"dear\s+\w+", r"hello\s+\w+", r"hi\s+\w+", r"your account", r"your password", r"your payment",
]

SUSPICIOUS_WORDS = [
    "verify", "urgent", "confirm", "account", "suspend", "security", "update", "click", "login", "password",
]

# --- fixed values: label vocabularies ------------------------------------------------------------

INGEST_LABELS = {
    "1": 1, "true": 1, "yes": 1, "spam": 1, "phishing": 1, "malicious": 1, "fraud": 1, "attack": 1, "bad": 1,
    "phishing email": 1, "spam email": 1,
    "0": 0, "false": 0, "no": 0, "ham": 0, "legitimate": 0, "benign": 0, "good": 0, "normal": 0,
    "legitimate email": 0, "not spam": 0,
}
INGEST_POSITIVE_PATTERN = r"(phish|spam|malicious|fraud|attack|scam|fake|decept)"
INGEST_NEGATIVE_PATTERN = r"(legit|ham|benign|safe|normal|clean|valid)"

TRAINING_POSITIVE = ["1", "true", "phish", "spam", "fraud", "malicious", "malware", "phishing"]
TRAINING_NEGATIVE = ["0", "false", "ham", "legit", "benign", "safe", "ham_email"]

CV_POSITIVE = ["1", "true", "phish", "spam", "malicious", "bad"]
CV_NEGATIVE = ["0", "false", "benign", "ham", "good", "safe"]

# --- fixed values: column aliases (ordered, first match wins) ------------------------------------

LABEL_ALIASES = [
    "label", "labels", "class", "result", "target", "email type", "email_type", "type", "category", "y",
    "is_spam", "is_phish", "is_phishing", "phishing",
]
TEXT_ALIASES = [
    "text", "body", "message", "content", "email text", "email_text", "msg", "sms", "payload", "raw", "title",
]
URL_ALIASES = ["url", "link", "href", "domain"]
TIMESTAMP_ALIASES = ["timestamp", "date", "datetime", "time"]
TEXT_PARTS = ["body", "content", "url", "subject", "message", "email", "raw", "payload", "title"]
CV_LABEL_COLUMNS = ["label", "is_phish", "target", "y"]
NEAR_DUPLICATE_COLUMNS = ["text", "body", "subject", "url", "message", "content"]

# --- fixed values: numeric constants ---------------------------------------------------------------

TARGET_FPR = 0.003
COST_FP = 1.0
COST_FN = 10.0
MIN_RECALL = 0.80
DRIFT_ALERT = 0.10
PSI_FEATURE_LIMIT = 0.20
MEAN_SHIFT_LIMIT = 3.0
DRIFT_BINS = 10
DRIFT_EPSILON = 1e-10
HISTORY_LIMIT = 2000
NEAR_DUPLICATE_SIMILARITY = 0.975
LOW_VARIANCE = 0.01
PROBABILITY_EPSILON = 1e-9
MODEL_PREFERENCE = ["LightGBM", "XGB", "CatBoost", "LR", "RF"]

# --- fixed values: declarative feature specifications -----------------------------------------------

EMAIL_ADDRESS = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
LINK_START = r"(?i)\bhttps?://"


def _spec(name, type_, source, **extra):
    return {"name": name, "type": type_, "source": source, **extra}


URL_SPECS = [
    _spec("url_len", "len", "url"),
    _spec("host_len", "len", "host"),
    _spec("path_len", "len", "path"),
    _spec("query_len", "len", "query"),
    _spec("num_params", "regex_count", "url", pattern=r"(?<!%)(&|\?)\w+="),
    _spec("num_subdomains", "subdomain_count", "host"),
    _spec("tld_len", "tld_len", "host"),
    _spec("digits_in_host", "regex_count", "host", pattern=r"\d"),
    _spec("hyphens_in_host", "regex_count", "host", pattern=r"-"),
    _spec("dots_in_path", "regex_count", "path", pattern=r"\."),
    _spec("slashes_count", "regex_count", "path", pattern=r"/"),
    _spec("has_multiple_slashes", "regex_bool", "path", pattern=r"//.+/"),
    _spec("has_port", "regex_bool", "host", pattern=r":[0-9]{2,5}$"),
    _spec("has_at_symbol", "regex_bool", "url", pattern=r"@"),
    _spec("has_pct_encoding", "regex_bool", "url", pattern=r"%[0-9A-Fa-f]{2}"),
    _spec("has_unicode_punycode", "regex_bool", "host", pattern=r"xn--"),
    _spec("host_is_ipv4", "regex_bool", "host", pattern=r"^(?:\d{1,3}\.){3}\d{1,3}$"),
    _spec("starts_https", "regex_bool", "url", pattern=r"(?i)^https://"),
    _spec("has_ext_like_html", "regex_bool", "path", pattern=r"\.(php|asp|aspx|jsp|cfm|html?)($|[?&#])"),
    _spec("shortener_domain", "domain_in_list", "host",
          list=["bit.ly", "goo.gl", "t.co", "tinyurl.com", "ow.ly", "is.gd", "buff.ly", "cutt.ly", "rebrand.ly",
                "t.ly"]),
    _spec("keyword_login", "regex_bool", "url", pattern=r"(?i)login|signin|account|verify|secure"),
    _spec("keyword_bank", "regex_bool", "url", pattern=r"(?i)bank|paypal|wallet|invoice|billing|refund"),
    _spec("keyword_arabic_sensitive", "regex_bool", "url",
          pattern=r"تسجيل|حساب|تحقق|أمان|بطاقة|دفع|بنك|رصيد|فاتورة"),
    _spec("query_has_token_like", "regex_bool", "query", pattern=r"(?i)(token|session|auth|password|pass)=.{6,}"),
    _spec("query_has_email", "regex_bool", "query", pattern=EMAIL_ADDRESS),
    _spec("rare_domain_flag", "lookup_bool", "domain", lookup="is_rare_domain"),
    _spec("top1m_umbrella", "lookup_bool", "domain", lookup="umbrella_top1m"),
    _spec("top1m_majestic", "lookup_bool", "domain", lookup="majestic_top1m"),
    _spec("path_suspicious_mix", "regex_bool", "path", pattern=r"(?i)(%2e|\.|\-){2,}(/|$)|([A-Za-z0-9]{24,})"),
    _spec("has_double_extension", "regex_bool", "path", pattern=r"\.(zip|rar|7z|exe)\.(php|html?)$"),
]

EMAIL_SPECS = [
    _spec("subj_len", "len", "email_subject"),
    _spec("body_len", "len", "email_body"),
    _spec("subj_words", "word_count", "email_subject"),
    _spec("body_words", "word_count", "email_body"),
    _spec("body_entropy", "entropy", "email_body"),
    _spec("num_urls_body", "regex_count", "email_body", pattern=LINK_START),
    _spec("num_emails_body", "regex_count", "email_body", pattern=EMAIL_ADDRESS),
    _spec("num_phones_body", "regex_count", "email_body", pattern=r"(?i)(\+?\d[\d\s().-]{7,}\d)"),
    _spec("has_html_anchor", "regex_bool", "email_body", pattern=r"<a\s+[^>]*href="),
    _spec("has_inline_js", "regex_bool", "email_body", pattern=r"<script\b"),
    _spec("has_form", "regex_bool", "email_body", pattern=r"<form\b"),
    _spec("subj_has_urgent", "regex_bool", "email_subject",
          pattern=r"(?i)urgent|immediately|action required|verify|update"),
    _spec("subj_has_urgent_ar", "regex_bool", "email_subject", pattern=r"عاجل|فوري|مطلوب إجراء|تحقق|تحديث"),
    _spec("body_has_threat", "regex_bool", "email_body",
          pattern=r"(?i)suspend|suspension|disabled|limit|violation|penalty"),
    _spec("body_has_threat_ar", "regex_bool", "email_body", pattern=r"تعليق|إيقاف|تقييد|مخالفة|عقوبة|تنبيه"),
    _spec("body_money_terms", "regex_count", "email_body",
          pattern=r"(?i)invoice|payment|bank|wallet|crypto|refund|prize|lottery|transfer"),
    _spec("body_money_terms_ar", "regex_count", "email_body",
          pattern=r"فاتورة|دفعة|بنك|محفظة|تحويل|جائزة|سحب|استرداد|بطاقة|رصيد"),
    _spec("has_credentials_req", "regex_bool", "email_body", pattern=r"(?i)password|passcode|otp|two[- ]?factor|code"),
    _spec("has_credentials_req_ar", "regex_bool", "email_body",
          pattern=r"كلمة\s?المرور|المرور|رمز|توثيق|تحقق\s?ثنائي|كود"),
    _spec("arabic_ratio_body", "char_ratio", "email_body", charset="arabic"),
    _spec("latin_ratio_body", "char_ratio", "email_body", charset="latin"),
    _spec("has_whatsapp", "regex_bool", "email_body", pattern=r"(?i)whatsapp|واتساب"),
    _spec("has_crypto_addr_like", "regex_bool", "email_body",
          pattern=r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b|\b0x[a-fA-F0-9]{40}\b"),
    _spec("has_iban_like", "regex_bool", "email_body", pattern=r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b"),
    _spec("subj_excess_punct", "regex_count", "email_subject", pattern=r"[!?]{2,}"),
    _spec("body_excess_punct", "regex_count", "email_body", pattern=r"[!?]{2,}"),
    _spec("url_shortener_in_body", "regex_bool", "email_body",
          pattern=r"(?i)(bit\.ly|t\.co|tinyurl\.com|is\.gd|cutt\.ly|rebrand\.ly|t\.ly)/"),
]

COMMON_SPECS = [
    _spec("feat_len_chars", "len", "text_joined"),
    _spec("feat_len_words", "word_count", "text_joined"),
    _spec("feat_entropy_chars", "entropy", "text_joined"),
    _spec("feat_ratio_arabic", "char_ratio", "text_joined", charset="arabic"),
    _spec("feat_ratio_latin", "char_ratio", "text_joined", charset="latin"),
    _spec("feat_ratio_digits", "char_ratio", "text_joined", charset="digits"),
    _spec("feat_ratio_punct", "char_ratio", "text_joined", charset="punct"),
    _spec("feat_unique_char_count", "unique_chars", "text_joined"),
    _spec("feat_max_char_run", "max_run_len", "text_joined"),
    _spec("feat_has_rtl_marks", "regex_bool", "text_joined", pattern=r"\u200f|\u202b|\u202e"),
    _spec("feat_num_emails_in_text", "regex_count", "text_joined", pattern=EMAIL_ADDRESS),
    _spec("feat_num_urls_in_text", "regex_count", "text_joined", pattern=LINK_START),
]
