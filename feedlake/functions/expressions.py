"""Scalar expressions: every function returns a ``Column`` and stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400.0

# The reference year and the upper bound of each age band.
AGE_REFERENCE_YEAR = 2026
AGE_BANDS = [(25, "18-25"), (35, "26-35"), (45, "36-45"), (55, "46-55"), (65, "56-65")]
AGE_UNDER = "menor_de_18"
AGE_OVER = "66+"
AGE_UNKNOWN = "sin_dato"

# Weight of each event type in a user's vector profile.
EVENT_WEIGHTS = {
    "completado": 3.0,
    "guardado": 3.0,
    "compartido": 2.5,
    "me_gusta": 2.5,
    "reproduccion": 2.0,
    "vista": 1.5,
    "scroll": 1.0,
    "clic": 1.0,
    "impresion": 0.0,
    "no_me_interesa": -2.0,
}


def literal_ts(as_of) -> Column:
    """An explicit reference instant as a column; accepts a column or an ISO string."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")


def elapsed_seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two instants, fractional part included."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6)


def efolding(later: Column, earlier: Column, scale_seconds: float = DAY_SECONDS) -> Column:
    """Weight that falls by a factor *e* (not by half) every ``scale_seconds``."""
    return F.exp(-elapsed_seconds(later, earlier) / F.lit(float(scale_seconds)))


def ratio(num: Column, den: Column, digits: int = 5) -> Column:
    """Rounded quotient, NULL where the denominator is zero."""
    return F.round(num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0)), digits)


def age_band(birth_year: Column, reference_year: int = AGE_REFERENCE_YEAR) -> Column:
    age = F.lit(reference_year) - birth_year
    out = F.when(birth_year.isNull(), AGE_UNKNOWN).when(age < 18, AGE_UNDER)
    for upper, label in AGE_BANDS:
        out = out.when(age <= upper, label)
    return out.otherwise(AGE_OVER)


def hmac_sha256(message: Column, key: str) -> Column:
    """Keyed SHA-256 of a text column as lower-case hex; the key is the ASCII text itself."""
    import hashlib

    raw = key.encode("utf-8")
    block = 64
    if len(raw) > block:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(block, b"\0")
    inner = F.lit(bytes(b ^ 0x36 for b in raw))
    outer = F.lit(bytes(b ^ 0x5C for b in raw))
    digest = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def pseudonym(user_id: Column, salt: str) -> Column:
    return F.concat(F.lit("U-"), F.substring(hmac_sha256(user_id.cast("string"), salt), 1, 12))


def encrypt_text(value: Column, passphrase: str) -> Column:
    """AES-GCM ciphertext; the 256-bit key is the SHA-256 of the passphrase."""
    return F.aes_encrypt(F.encode(value, "UTF-8"), F.unhex(F.sha2(F.lit(passphrase), 256)), F.lit("GCM"))


def decrypt_text(value: Column, passphrase: str) -> Column:
    return F.decode(F.aes_decrypt(value, F.unhex(F.sha2(F.lit(passphrase), 256)), F.lit("GCM")), "UTF-8")


def session_key(user_id: Column, ts: Column) -> Column:
    """``S-<six-digit user>-<yyyyMMddHH>``: one key per user and hour."""
    return F.concat(F.lit("S-"), F.format_string("%06d", user_id), F.lit("-"), F.date_format(ts, "yyyyMMddHH"))


def _plain_letters() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letters, derived from their Unicode decomposition."""
    marked, plain = [], []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if chr(code).islower() and len(parts) > 1 and all(unicodedata.category(c) == "Mn" for c in parts[1:]):
            marked.append(chr(code))
            plain.append(parts[0])
    return "".join(marked), "".join(plain)


def without_accents(text: Column) -> Column:
    """Lower case with accents removed, whether a letter carries its accent or is followed by it."""
    marked, plain = _plain_letters()
    return F.regexp_replace(F.translate(F.lower(text), marked, plain), r"\p{Mn}", "")


def slug(text: Column) -> Column:
    """Accents stripped, lower case, each non-alphanumeric character replaced by ``-``, dashes trimmed."""
    return F.regexp_replace(F.regexp_replace(without_accents(text), r"[^\p{L}\p{N}]", "-"), "^-+|-+$", "")


def json_contains(doc: Column, pairs: dict[str, str]) -> Column:
    """Containment of flat key-value pairs, compared as text; all of them must hold."""
    out = F.lit(True)
    for key, value in pairs.items():
        out = out & F.coalesce(F.get_json_object(doc, f"$.{key}") == F.lit(value), F.lit(False))
    return out


def json_has_key(doc: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(doc), key), F.lit(False))


def ab_variant(user_id: Column) -> Column:
    return F.when(user_id % 2 == 0, F.lit("tratamiento")).otherwise(F.lit("control"))


def event_weight(kind: Column, weights: dict[str, float] | None = None) -> Column:
    out = None
    for name, value in (weights or EVENT_WEIGHTS).items():
        cond = kind == name
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out.otherwise(F.lit(0.0))


def embedding_text(section: Column, title: Column, standfirst: Column, tags: Column) -> Column:
    """``Section. title. standfirst Temas: a, b`` with missing parts left out."""
    tail = F.when(F.size(tags) > 0, F.concat(F.lit("Temas: "), F.array_join(F.array_sort(tags), ", ")))
    head = F.concat_ws(". ", section, title, standfirst)
    return F.concat_ws(" ", head, tail)


def calendar_columns(day: Column) -> dict[str, Column]:
    """Attributes of a calendar day; Monday is 1 and the weekend is Saturday and Sunday."""
    weekday = F.weekday(day) + 1
    return {
        "fecha_key": F.date_format(day, "yyyyMMdd").cast("int"),
        "anio": F.year(day),
        "mes": F.month(day),
        "dia": F.dayofmonth(day),
        "trimestre": F.quarter(day),
        "dia_semana": weekday,
        "es_fin_semana": weekday >= 6,
    }


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def month_text(ts: Column) -> Column:
    """Partition value of a month, ``yyyy-MM``."""
    return F.date_format(ts, "yyyy-MM")


def tokens(text: Column) -> Column:
    """Lower-case words: maximal runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def stem(word: Column) -> Column:
    """Light suffix rule: plural endings dropped from words of five letters or more."""
    size = F.length(word)
    return (F.when(size < 5, word)
            .when(word.endswith("es"), F.substring(word, F.lit(1), size - 2))
            .when(word.endswith("s"), F.substring(word, F.lit(1), size - 1))
            .otherwise(word))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))
