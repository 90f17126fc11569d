"""Text functions of the archive, as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters that slugs keep besides ASCII letters, digits and the underscore.
SLUG_KEEPS = "a-z0-9_\\x{3040}-\\x{309F}\\x{30A0}-\\x{30FF}\\x{4E00}-\\x{9FFF}"
# Unicode white space, for the inside of a character class.
WHITE = "\\t-\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"
# Media types by extension.
MEDIA_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain",
    "rs": "text/x-code", "py": "text/x-code", "js": "text/x-code", "ts": "text/x-code", "go": "text/x-code", "java": "text/x-code", "c": "text/x-code", "h": "text/x-code", "cpp": "text/x-code",
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp", "gif": "image/gif",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
TEXT_NATIVE = ["text/markdown", "text/plain", "text/x-code"]
# Paths and names that hold secrets (tier A), and words in names that suggest one (tier B).
SECRET_PATHS = [".kube/config", ".docker/config.json"]
SECRET_FOLDERS = [".ssh/", ".gnupg/", ".aws/", ".kube/", ".docker/"]
SECRET_NAMES = [".env", ".ssh", ".gnupg", ".aws", ".kube", ".docker", ".netrc", ".npmrc", ".pypirc"]
SECRET_BEGINNINGS = [".env.", "id_rsa", "id_ecdsa", "id_ed25519"]
SECRET_ENDINGS = [".pem", ".key", ".p12", ".pfx", ".keystore", ".tfstate"]
SECRET_INNER = [".tfstate."]
SECRET_WORDS = ["credentials", "secret", "token", "apikey", "password"]


@F.pandas_udf(T.StringType())  # type object, so no session is needed at import
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark has no function for."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfc_each(texts: pd.Series) -> pd.Series:
    """NFC of every element of an array."""
    return texts.map(lambda ts: [None if t is None else unicodedata.normalize("NFC", t) for t in ts], na_action="ignore")


def slug_of_nfc(title: Column) -> Column:
    """Slug of a composed title: ASCII lower case, white space and hyphens to one hyphen, other characters dropped."""
    low = F.translate(title, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    kept = F.regexp_replace(low, f"[^{SLUG_KEEPS}{WHITE}-]", "")
    return F.regexp_replace(F.regexp_replace(kept, f"[{WHITE}-]+", "-"), "^-|-$", "")


def slug(title: Column) -> Column:
    """Lower-case ASCII, hyphens for blanks; underscore, digits, kana and ideographs stay, all else goes."""
    return slug_of_nfc(nfc(title))


def section_id(path: Column) -> Column:
    """Slugs of a heading path joined by '/', empty ones left out; null for none."""
    s = F.array_join(F.filter(F.transform(nfc_each(path), slug_of_nfc), lambda x: x != ""), "/")
    return F.when(s != "", s)


def media_type(name: Column) -> Column:
    """By the lower-cased extension, octet-stream otherwise."""
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    ext = F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))
    return F.coalesce(F.try_element_at(kinds, ext), F.lit("application/octet-stream"))


def secret_tier(path: Column) -> Column:
    """'A' for paths and names known to hold secrets, 'B' for suggestive names, else null."""
    low = F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))
    name = F.substring_index(low, "/", -1)
    a = low.isin(SECRET_PATHS) | name.isin(SECRET_NAMES)
    for test, values in ((low.startswith, SECRET_FOLDERS), (name.startswith, SECRET_BEGINNINGS), (name.endswith, SECRET_ENDINGS), (name.contains, SECRET_INNER)):
        for v in values:
            a = a | test(v)
    b = F.lit(False)
    for w in SECRET_WORDS:
        b = b | name.contains(w)
    return F.when(a, "A").when(b, "B")


def filename_context(path: Column) -> Column:
    """A file name as words: folders and last extension off, '-', '_' and case changes to blanks; null without letter or digit."""
    name = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(name, r"(?<=[^/])\.[^.]*$", "")
    words = F.regexp_replace(F.regexp_replace(stem, "[-_]", " "), "(?<=[a-z0-9])(?=[A-Z])", " ")
    flat = F.regexp_replace(F.regexp_replace(words, f"[{WHITE}]+", " "), "^ | $", "")
    return F.when(flat.rlike(r"[\p{L}\p{N}]"), flat)


def embedding_input(context: Column, text: Column) -> Column:
    """What an embedding adapter is given: the file's context, a blank line and the text; the text alone without context."""
    return F.when(context.isNull(), text).otherwise(F.concat(context, F.lit("\n\n"), text))


# Runs of one script: kana with the long-vowel marks after them, ideographs, ASCII letters and digits with points
# and commas kept between digits.
SEGMENT = r"((?:[\x{3041}-\x{309F}]\x{30FC}*)+|[\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}]+|[\x{4E00}-\x{9FFF}\x{3005}\x{3006}]+|[A-Za-z0-9]*[0-9](?:[.,][0-9](?:[A-Za-z0-9]*[0-9])?)*[.,][0-9][A-Za-z0-9]*|[A-Za-z0-9]+)"


def script_segments(text: Column) -> Column:
    """Pieces of a token at script borders; other signs part them and are no pieces."""
    return F.regexp_extract_all(text, F.lit(SEGMENT), F.lit(1))


def numeric_equivalents(number: Column) -> Column:
    """Both spellings of a whole number of four or more digits, with and without thousands commas."""
    plain = F.replace(number, F.lit(","))
    ok = number.rlike(r"^(\d{4,}|\d{1,3}(,\d{3})+)$")
    return F.when(ok, F.array(plain, F.format_number(plain.cast("bigint"), 0)))


def unit_key(kind: Column, value: Column) -> Column:
    """page:n and slide:n without leading zeros (1 at least), sheet:name in NFC with '#' doubled, image:x, doc:1."""
    n = F.greatest(F.regexp_replace(value, "^0+", ""), F.lit("1"))
    sheet = F.concat(F.lit("sheet:"), F.replace(nfc(value), F.lit("#"), F.lit("##")))
    return F.when(kind.isin("page", "slide"), F.concat(kind, F.lit(":"), n)).when(kind == "sheet", sheet).when(kind == "image", F.concat(F.lit("image:"), value)).otherwise(F.lit("doc:1"))


SCHEME = "ev"
_HASH = "sha256:[0-9a-f]{64}"


def image_references(markdown: Column, scheme: str = SCHEME) -> Column:
    """Image objects that a text shows: targets of Markdown images that are image object URIs, each once, in order of
    first mention. A target ends at the first ')' after the first '](' after '!['; anything else is left out."""
    targets = F.regexp_extract_all(markdown, F.lit(r"(?s)!\[.*?\]\(([^)]*)\)"), F.lit(1))
    return F.array_distinct(F.filter(targets, lambda t: t.rlike(f"^{scheme}://[^/?]+/object/image/{_HASH}$")))


def object_uri(uri: Column, scheme: str = SCHEME) -> Column:
    """scope_id, object_type and hash of an object URI; null for anything else, a query string included."""
    rx = f"^{scheme}://([^/?]+)/object/([^/?]+)/({_HASH})$"
    part = lambda i: F.regexp_extract(uri, rx, i)
    return F.when(uri.rlike(rx), F.struct(part(1).alias("scope_id"), part(2).alias("object_type"), part(3).alias("hash")))


# A tag, comment or instruction, or an autolink, between '<' and the next '>' of one line, 511 characters at most.
RAW_HTML = r"<(?:[A-Za-z/!?][^>\n]{0,510}>|[^>\n]{0,508}://[^>\n]{0,508}>|[^> \n]{0,510}@[^> \n]{0,510}>)"


def has_raw_html(text: Column) -> Column:
    """Whether any line holds raw HTML or an autolink."""
    return text.rlike(RAW_HTML)


def fence_for(text: Column) -> Column:
    """A code fence longer than any run of backticks that a line begins with, three at least."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(f"(?m)^[{WHITE}]*(`+)"), F.lit(1)), lambda r: F.char_length(r))
    return F.repeat(F.lit("`"), F.greatest(F.lit(2), F.coalesce(F.array_max(runs), F.lit(0))) + 1)


def redact_paths(text: Column) -> Column:
    """Absolute paths cut to their last part."""
    return F.regexp_replace(text, r"(?<![\w.])/(?:[\w.-]+/)+([\w.-]+)", "<path>/$1")


def is_real_text(text: Column) -> Column:
    """Whether at least 85 % of the trimmed characters print: no controls but white space, no replacement characters."""
    body = F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")
    bad = F.regexp_count(body, F.lit(r"[\x00-\x08\x0E-\x1F\x7F-\x{84}\x{86}-\x{9F}\x{FFFD}]"))
    return (F.char_length(body) > 0) & ((F.char_length(body) - bad) * 100 >= F.char_length(body) * 85)


def duration_seconds(text: Column) -> Column:
    """Seconds of '15m', '2h', '7d', '1w', '30s'; null for anything else, for zero and beyond 64 bits."""
    n = F.regexp_extract(text, r"^([0-9]+)([smhdw])$", 1).try_cast("bigint")
    unit = F.regexp_extract(text, r"^([0-9]+)([smhdw])$", 2)
    size = F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.nullif(F.try_multiply(n, size.cast("bigint")), F.lit(0).cast("bigint"))


def since_cutoff(now: Column, text: Column) -> Column:
    """The moment a duration before ``now``; null for a bad duration or a year that four digits cannot hold."""
    at = F.timestamp_micros(F.unix_micros(now) - duration_seconds(text) * 1_000_000)
    seconds = F.unix_seconds(now) - duration_seconds(text)
    return F.when(seconds.between(-62_135_596_800, 253_402_300_799), at)


def is_utc_timestamp(text: Column) -> Column:
    """YYYY-MM-DDThh:mm:ss with optional fraction and Z, of an existing day."""
    return F.coalesce(text.rlike(r"^\d{4}-\d\d-\d\dT([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?Z$") & F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def excel_date(serial: Column) -> Column:
    """Day of a spreadsheet serial as text; serials up to 60 stay numbers."""
    return F.when(serial <= 60, serial.cast("string")).otherwise(F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), (serial - 25569).cast("int")), "yyyy-MM-dd"))


def column_number(letters: Column) -> Column:
    """1 for A, 27 for AA."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0).cast("bigint"), lambda a, ch: F.when(ch == "", a).otherwise(a * 26 + F.ascii(ch) - 64))


def glob_to_regex(glob: str) -> str:
    """A glob as a regular expression: '*' and '?' stop at '/', '**' does not."""
    import re

    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def ignored(path: Column, rules: list[str]) -> Column:
    """Ignore rules in order, the last match wins, '!' includes again."""
    state = F.lit(False)
    for rule in rules:
        keep, glob = rule.startswith("!"), rule.lstrip("!")
        state = F.when(path.rlike(glob_to_regex(glob)), not keep).otherwise(state)
    return state


def logical_path_ok(path: Column) -> Column:
    """Whether a stored path is a direct child: not empty, '.' or '..', without '/' and NUL."""
    return F.coalesce((path != "") & ~path.isin(".", "..") & ~path.contains("/") & ~path.contains("\x00"), F.lit(False))


# Characters and device names no portable leaf may hold.
PORTABLE_BAD = r'[\x00-\x1F\x7F<>:"/\\|?*]'
PORTABLE_DEVICES = r"(?i)^(?:CON|PRN|AUX|NUL|COM[1-9¹²³]|LPT[1-9¹²³])$"


def portable_leaf_error(name: Column) -> Column:
    """Why a name cannot be a file on every system, null where it can."""
    stem = F.regexp_replace(F.substring_index(name, ".", 1), "[. ]+$", "")
    return (
        F.when(name.isin("", ".", ".."), "empty")
        .when(F.octet_length(F.encode(name, "UTF-16BE")) > 510, "too_long")
        .when(name.rlike("[. ]$"), "trailing_dot_or_space")
        .when(name.rlike(PORTABLE_BAD), "forbidden_character")
        .when(stem.rlike(PORTABLE_DEVICES), "reserved_name")
    )


def collision_key(name: Column) -> Column:
    """NFC in lower case: names with one key cannot stand side by side on every system."""
    return F.lower(nfc(name))


def tag_leaf(name: Column) -> Column:
    return F.concat(F.lit("tag-"), F.sha2(collision_key(name).cast("binary"), 256))


def quarantine_reason(path: Column, size: Column, most_bytes: int) -> Column:
    """Why a scanned file is held back: too large, a known secret, or a suggested one that needs approval."""
    tier = secret_tier(path)
    return F.when(size > most_bytes, "too_large").when(tier == "A", "secrets_tier_a").when(tier == "B", "secrets_tier_b")


def hold_reason(reason: Column) -> Column:
    """The hold a failure reason puts a task on."""
    return F.when(reason == "budget_exceeded", "budget").when(reason == "secrets_tier_b", "tier_b_approval").when(reason == "auth_error", "auth")


def query_units(query: Column) -> Column:
    """Search units of a query: its tokens in NFC and their script pieces, each once, in order."""
    tokens = F.filter(F.split(nfc(query), f"[{WHITE}]+"), lambda t: t != "")
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.concat(F.array(t), script_segments(t)))))


def in_scope(root: Column, wanted: str | None, descendants: bool = False) -> Column:
    """Scope selection: all (no root wanted), one root, or a root and what lies below it at a path border."""
    if wanted is None:
        return F.lit(True)
    base = wanted.rstrip("/")
    return (root == base) | root.startswith(base + "/") if descendants else root == base


def mutable_alias(pin: Column) -> Column:
    """Whether a model pin is an alias that can move."""
    return F.lower(pin).rlike("^latest$|[-_]latest$")


def prompt_template(text: Column) -> Column:
    """A prompt template in its canonical form: LF, no blanks at line ends, no empty lines at the end, NFC."""
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return nfc(F.regexp_replace(F.regexp_replace(lf, "[ \\t]+(?=\n|$)", ""), "\n+$", ""))
