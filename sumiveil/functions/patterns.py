"""Patterns, word lists and label tables, in the regular-expression dialect of the JVM.

``(?U)`` makes ``\\d`` and ``\\s`` cover full-width digits and the ideographic blank.
"""

# Fixed values.
SEP = "[-－‐‑−–— 　]"
DASH = "[-－‐‑−–—]"
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = (
    rf"(?U)(?<![\d\-－])(?:[+＋]81{SEP}?\d{{1,4}}{SEP}\d{{1,4}}{SEP}\d{{3,4}}|[0０]\d{{1,4}}{SEP}\d{{1,4}}{SEP}\d{{3,4}}"
    r"|[0０]\d{1,4}[(（]\d{1,4}[)）]\d{3,4}|[0０]\d{9,10})(?![\d\-－])"
)
POSTAL = rf"(?U)(?<![\d\-－])\d{{3}}{DASH}\d{{4}}(?![\d\-－])"
NAME_CHARS = "[一-龥々〆ヶぁ-んァ-ヶー・ゝゞ0-9０-９a-zA-Zａ-ｚＡ-Ｚ]"
COMPANY_FORMS = r"株式会社|有限会社|合同会社|合名会社|合資会社|一般社団法人|一般財団法人|公益社団法人|公益財団法人|協同組合|（株）|\(株\)|（有）|\(有\)"
COMPANY_BEFORE = rf"(?U)(?:{COMPANY_FORMS})\s?{NAME_CHARS}{{1,25}}"
COMPANY_AFTER = rf"(?U){NAME_CHARS}{{1,25}}\s?(?:{COMPANY_FORMS}|㈱|㈲)"
_BUILDING = "(?:ビルディング|ビル|タワー|センター|オフィス|プラザ|マンション|ハイツ|コーポ|棟)"
_INNER = "[0-9０-９A-Za-zＡ-Ｚａ-ｚ一-龥ぁ-んァ-ヶ・ー]{0,24}?"
# The chain of building names is possessive: what follows it may be empty, so it never has to give a
# link back, and the JVM's matcher, which recurses on a chain that may, goes through this one in a loop.
ADDRESS = (
    r"(?:北海道|東京都|京都府|大阪府|[一-龥]{2,3}県)[一-龥ぁ-んァ-ヶー]{1,16}?[0-9０-９][0-9０-９丁目番地号条\-－ー−―‐]*"
    rf"(?:[ 　]?[0-9０-９A-Za-zＡ-Ｚａ-ｚ一-龥ァ-ヶ・ー]{_INNER}{_BUILDING}(?:{_INNER}{_BUILDING})*+(?:[0-9０-９]{{1,4}}(?:階|Ｆ|F|号室|号)?)?)?"
)
PREFECTURE = r"(?U)(?:北海道|東京都|京都府|大阪府|[^\s\d,、／/]{2,3}県)"
PII_SPLIT = rf"(?U)(?:{EMAIL})|(?:(?<![\d\-])(?:0\d{{1,4}}-\d{{1,4}}-\d{{3,4}}|0\d{{9,10}})(?![\d\-]))|(?:(?<![\d\-])\d{{3}}-\d{{4}}(?![\d\-]))"
NUMBER_PATTERNS = (("EMAIL", EMAIL), ("PHONE", PHONE), ("POSTAL", POSTAL))
LABEL_MAP = {"PER": "PERSON", "ORG": "ORGANIZATION", "LOC": "LOCATION", "INS": "LOCATION"}
CANDIDATE_TYPES = ("PERSON", "ORGANIZATION", "LOCATION")
TOKEN_PREFIX = {"PERSON": "PERSON", "ORGANIZATION": "COMPANY", "LOCATION": "ADDRESS", "EMAIL": "EMAIL", "PHONE": "PHONE", "POSTAL": "POSTAL", "ID": "ID"}
LABEL_JA = {"PERSON": "人名", "COMPANY": "会社名", "ADDRESS": "住所", "EMAIL": "メール", "PHONE": "電話", "POSTAL": "郵便番号", "ID": "識別子"}
CATEGORY = {"PERSON": "person", "ORGANIZATION": "company", "LOCATION": "address", "EMAIL": "email", "PHONE": "phone", "POSTAL": "postal", "ID": "id"}
CATEGORY_KIND = {"person": "PERSON", "company": "ORGANIZATION", "address": "LOCATION", "email": "EMAIL", "phone": "PHONE", "id": "ID"}
REVERSIBLE = r"\{\{[A-Z]+_\d+\}\}"
IRREVERSIBLE = r"\[(?:人名|会社名|住所|メール|電話|郵便番号|識別子)\d+\]"
PLACEHOLDER = f"(?U){REVERSIBLE}|{IRREVERSIBLE}"
COMPANY_MARKERS = ("株式会社", "有限会社", "合同会社", "合名会社", "合資会社", "一般社団法人", "一般財団法人", "公益社団法人", "公益財団法人", "協同組合", "（株）", "(株)", "（有）", "(有)")
DEPARTMENT_ENDS = ("部", "課", "室", "局", "本部", "事業部", "係")
ORG_DELIMITERS = " \t\n\r　、。，,／/（）()「」『』【】《》〈〉×＊*：:；;"
LOCATION_STRIP = " \t\n\r　、。／/"
FILE_EXTENSIONS = ("msg", "eml", "docx", "pptx", "xlsx", "pdf", "txt", "csv", "md", "doc", "xls", "ppt", "rtf", "zip", "7z", "rar", "htm", "html", "xml", "json", "log", "jpg", "jpeg", "png", "gif", "bmp", "tif", "tiff", "mp3", "mp4", "mov", "wav", "ics", "vcf")
ORG_HEAD_JUNK = r"(?U)^[\d\s\-−ー－,.、／/¥￥%（）()]+"
LOCATION_DIGIT = "[0-9０-９〇一二三四五六七八九十百千]"
PERSON_ADDRESS_NOISE = "[0-9０-９]|丁目|番地"
NARROW_SPACE = " \t\r\n\v\f 　"
WORD_CHAR = (
    r"[0-9A-Za-z\x{80}-\x{9F}\x{C0}-\x{1FFF}\x{2070}-\x{2DFF}\x{2E80}-\x{2FFF}\x{3040}-\x{30FA}\x{30FC}-\x{FEFF}"
    r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FFFC}\x{FFFE}-\x{10FFFF}]"
)
RUBY = "(?<=[一-龥々〆ヶ])[（(][ぁ-んァ-ヶーゝゞ・]{1,10}[）)]"
SINGLE_KANJI = r"^[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}\x{3005}]$"
LINE_BREAK = r"(?:\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])"
PLACEHOLDER_VALUES = ("-", "—", "－", "―", "ー", "−", "–", "/", "／", "*", "＊", "?", "？", "…", "・", "なし", "無し", "無", "ナシ", "n/a", "na", "n.a.", "null", "none", "未定", "不明", "未設定", "未入力", "未登録", "該当なし", "同上", "〃", "tbd", "tba", "(空白)", "（空白）", "空欄")
MAIL_HEADERS = ("From", "To", "Cc", "Bcc", "Reply-To", "Sender", "Return-Path")
