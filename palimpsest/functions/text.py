"""Text cleaning, tokens, stamps and small scalar functions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------------------------------------
WIDE_PUNCT = "，。：；？！（）「」『』、"
NARROW_PUNCT = ",.:;?!()\"\"\"\","
STOP_WORDS = ["the", "a", "an", "and", "or", "to", "of", "in", "is", "are", "was", "were", "on", "for", "with", "at", "by", "it", "this", "that"]
CJK_TOKEN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
CJK_DENSE = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
FENCE_TAGS = ["action", "memory", "interest", "debug"]
FRENCH_MARKS = "[àâçéèêëîïôùûüÿœæ]"
STAMP_SHORT = "MM.ddEEE HH:mm"
STAMP_LONG = "yyMMddEEE HH:mm"
STAMP_LINE = r"\[\d{6}\w{3} \d{2}:\d{2}\]"
RESULT_MARK = "function result: [result]"
# -----------------------------------------------------------------------------------------------------------

_ASCII = "".join(chr(c) for c in range(0x21, 0x7F))
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(col, fn) -> Column:
    """``fn`` of a column that is computed once per row, however often ``fn`` reads it (a lambda variable)."""
    return F.get(F.transform(F.array(_c(col)), fn), 0)


def trim_ws(col) -> Column:
    """Trim every kind of ASCII white space, not only blanks."""
    return F.regexp_replace(_c(col), r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$", "")


@F.pandas_udf(T.StringType())
def _mask_results(texts: pd.Series) -> pd.Series:
    """Braces nest to any depth: each is matched once, then markers are read from left to right."""
    head, brace = re.compile(r"function\sresult:\s*(?=\{)"), re.compile(r"[{}]")

    def mask(text):
        ends, stack = {}, []
        for m in brace.finditer(text):
            if m.group() == "{":
                stack.append(m.start())
            elif stack:
                ends[stack.pop()] = m.end()
        out, at = [], 0
        for m in head.finditer(text):
            if m.start() >= at and m.end() in ends:
                out += [text[at : m.start()], RESULT_MARK]
                at = ends[m.end()]
        return "".join(out) + text[at:]

    return texts.map(lambda t: t if t is None else mask(t))


def filter_function_result(col) -> Column:
    """Replace ``function result: {...}`` with a short mark; braces may nest. Texts without the words stay out of Python."""
    c = _c(col)
    marked = c.contains("result:")
    return F.when(~marked, c).otherwise(_mask_results(F.when(marked, c)))


def mask_fences(col, tags=None) -> Column:
    """Replace fenced blocks of the known tags with [cmd]."""
    return F.regexp_replace(_c(col), r"(?s)~{3}(?:" + "|".join(tags or FENCE_TAGS) + r")\s*.*?~{3}", "[cmd]")


def pre_sanitize(col) -> Column:
    return filter_function_result(mask_fences(col))


def filter_memory_content(col) -> Column:
    """Flat variant: no nesting, and every fence goes."""
    flat = F.regexp_replace(_c(col), r"function result:\s*\{[^}]*\}", RESULT_MARK)
    return F.regexp_replace(flat, r"(?s)~~~.*?~~~", "[cmd]")


def split_sentences(col) -> Column:
    """Array of sentences: split after . ! ? and white space, or after a CJK full stop."""
    return F.filter(F.split(_c(col), r"(?U)(?<=[.!?])\s+|(?<=[。！？])\s*"), lambda s: F.regexp_like(s, F.lit(r"(?U)\S")))


def collapse_newlines(col) -> Column:
    return F.regexp_replace(_c(col), r"\n{2,}", "\n")


def concat_roles(col, roles=("User", "Assistant")) -> Column:
    """Merge consecutive lines of one role inside a text unless a stamp starts a new group."""
    names = "|".join(roles)
    stamped, lone, plain = rf"^({STAMP_LINE})\s*({names}):\s*(.*)$", rf"^{STAMP_LINE}\s*$", rf"^({names}):\s*(.*)$"
    lines = F.split(F.regexp_replace(_c(col), r"(?U)^\s+|\s+$", ""), r"\R")
    none = F.lit(None).cast("string")

    def state(out, role, active, fresh):
        return F.struct(out.alias("out"), role.alias("role"), active.alias("active"), fresh.alias("fresh"))

    def close(a):
        return F.when(a["active"], F.regexp_replace(a["out"], r"(?U)\s+$", "")).otherwise(a["out"])

    def glue(text, part):
        return F.when(text.isNull(), part).otherwise(F.concat(text, F.lit("\n"), part))

    def part(out, fresh, text):
        return F.when(text == "", out).otherwise(F.concat(out, F.when(fresh, F.lit(" ")).otherwise(F.lit("\n")), text))

    def step(a, line):
        g = lambda p, i: F.regexp_extract(line, p, i)
        is_stamped, is_lone, is_plain = (F.regexp_like(line, F.lit(p)) for p in (stamped, lone, plain))
        same = is_plain & a["active"] & (g(plain, 1) == a["role"])
        opened = F.when(is_stamped, F.concat(g(stamped, 1), F.lit(" "), g(stamped, 2), F.lit(":"))).otherwise(F.concat(g(plain, 1), F.lit(":")))
        text = F.when(is_stamped, g(stamped, 3)).otherwise(g(plain, 2))
        role = F.when(is_stamped, g(stamped, 2)).otherwise(g(plain, 1))
        begin = state(part(glue(close(a), opened), F.lit(True), text), role, F.lit(True), text == "")
        more = lambda t: state(part(a["out"], a["fresh"], t), a["role"], F.lit(True), a["fresh"] & (t == ""))
        return (
            F.when(same, more(g(plain, 2)))
            .when(is_stamped | is_plain, begin)
            .when(is_lone, state(glue(close(a), line), none, F.lit(False), F.lit(True)))
            .when(a["active"], more(line))
            .otherwise(state(glue(a["out"], line), a["role"], F.lit(False), F.lit(True)))
        )

    return F.aggregate(lines, state(none, none, F.lit(False), F.lit(True)), step, lambda a: F.coalesce(close(a), F.lit("")))


def chunk_post(col, roles=("User", "Assistant")) -> Column:
    return concat_roles(collapse_newlines(col), roles)


@F.pandas_udf(T.StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))


def normalize_nfc(col) -> Column:
    """NFC, one kind of newline, trimmed. Only texts with combining marks go through Python."""
    c = F.coalesce(_c(col), F.lit(""))
    plain = F.regexp_like(c, F.lit(r"^[\x00-\x{2FF}]*$"))
    c = F.when(plain, c).otherwise(_nfc(F.when(~plain, c)))
    return F.regexp_replace(F.regexp_replace(c, r"\r\n?", "\n"), r"(?U)^\s+|\s+$", "")


def sanitize_punct(col) -> Column:
    """Spaced dashes to commas, doubled commas and blanks collapsed, paragraphs outside fences."""
    c = F.regexp_replace(_c(col), r"\h(?:—|–|--|-)\h", ", ")
    c = F.regexp_replace(c, r"\s*,\s*,+", ", ")
    c = F.regexp_replace(c, r"[ \t]{2,}", " ")
    # mark single newlines, skipping over fences, then drop the mark each fence received
    c = F.regexp_replace(c, r"(~~~(?s:.*?)~~~)|(?<!\n)\n(?!\n)", "$1\u0001")
    c = F.regexp_replace(c, r"(~~~(?s:[^\x01]*?)~~~)\x01", "$1")
    c = F.regexp_replace(F.regexp_replace(c, r"\x01", "\n\n"), r"\n{3,}", "\n\n")
    return trim_ws(c)


def strip_fences(col) -> Column:
    return trim_ws(F.regexp_replace(_c(col), r"~~~\w+\s*\{[\s\S]*?\}\s*~~~", ""))


def detector_norm(col, suffix: str = "") -> Column:
    """Trim, one blank between words, ASCII punctuation, lower case. ``suffix='-'`` gives the historical form."""
    c = F.regexp_replace(trim_ws(col), r"(?U)\s+", " ")
    return F.concat(F.lower(F.translate(c, WIDE_PUNCT, NARROW_PUNCT)), F.lit(suffix))


@F.pandas_udf(T.StringType())
def _fold_kana(texts: pd.Series) -> pd.Series:
    half = re.compile("[｡-ﾟ]+")
    return texts.map(lambda t: t if t is None else half.sub(lambda m: unicodedata.normalize("NFKC", m.group()), t))


def alias_norm(col) -> Column:
    """Key for comparing aliases: lower case, one width, no quotes, brackets, dots or underscores; hyphens stay."""
    c = F.translate(F.lower(trim_ws(col)), _FULL + "　", _ASCII + " ")
    kana = F.regexp_like(c, F.lit("[｡-ﾟ]"))
    c = F.when(kana, _fold_kana(F.when(kana, c))).otherwise(c)
    c = F.regexp_replace(c, r"['\".,()\[\]{}_]+", " ")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


# letters that compare as others without being composed of them (fixed values)
_PLAIN_LETTERS = {"ł": "l", "ø": "o", "đ": "d", "ħ": "h", "ŧ": "t", "æ": "ae", "œ": "oe", "ı": "i"}


@F.pandas_udf(T.StringType())
def _fold_marks(texts: pd.Series) -> pd.Series:
    plain = str.maketrans(_PLAIN_LETTERS)

    def fold(text):
        bare = "".join(ch for ch in unicodedata.normalize("NFD", text.casefold()) if not unicodedata.combining(ch))
        return unicodedata.normalize("NFC", bare).translate(plain)

    return texts.map(lambda t: t if t is None else fold(t))


def alias_key(col) -> Column:
    """Case-, accent- and trailing-blank-insensitive comparison key; leading blanks count. Only texts beyond ASCII go through Python."""
    c = F.rtrim(_c(col))
    plain = F.regexp_like(c, F.lit(r"^\p{ASCII}*$"))
    return F.when(plain, F.lower(c)).otherwise(_fold_marks(F.when(~plain, c)))


def normalize_title(col, length: int = 255) -> Column:
    return F.substring(trim_ws(F.regexp_replace(_c(col), r"\s+", " ")), 1, length)


def tokenize_cjk(col) -> Column:
    """Lower-cased ASCII words, then single CJK characters; short words and stop words dropped; unique in order."""
    c = F.lower(_c(col))
    words = F.filter(F.regexp_extract_all(c, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(STOP_WORDS))
    return F.array_distinct(F.concat(words, F.regexp_extract_all(c, F.lit(CJK_TOKEN), F.lit(0))))


def rough_tokens(col) -> Column:
    """Crude token count: dense CJK, four bytes of anything else."""
    cjk = F.regexp_count(_c(col), F.lit(CJK_DENSE))
    return F.ceil(cjk + F.greatest(F.lit(0), F.octet_length(_c(col)) - 3 * cjk) / 4).cast("long")


def json_lenient(col) -> Column:
    """The text if it is a JSON object or array, else the repaired text if that is one, else null."""

    def shaped(t):
        # wrapped in a list, a lone value has length 1; trailing text breaks the list
        lone = F.coalesce(F.json_array_length(F.concat(F.lit("["), t, F.lit("]"))) == 1, F.lit(False))
        return F.regexp_like(t, F.lit(r"^\s*(\{[\s\S]*\}|\[[\s\S]*\])\s*$")) & lone

    def repaired(t):
        fixed = F.trim(F.regexp_replace(F.regexp_replace(t, "[“”‘’]", '"'), r",\s*([}\]])", "$1"))
        return bound(fixed, lambda f: F.when(shaped(f), f))

    return bound(col, lambda t: F.when(shaped(t), t).otherwise(repaired(t)))


def stamp_short(ts) -> Column:
    return F.concat(F.lit("["), F.date_format(_c(ts), STAMP_SHORT), F.lit("] "))


def stamp_long(ts) -> Column:
    return F.concat(F.lit("["), F.date_format(_c(ts), STAMP_LONG), F.lit("]"))


def parse_iso_ts(col) -> Column:
    """ISO time with Z or offset to an instant; null when it does not parse; a bare time is UTC."""
    return F.try_to_timestamp(F.regexp_replace(_c(col), "T", " "))


def hours_between(later, earlier) -> Column:
    return (F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / 3.6e9


def recency_weight(ts, now, half_life_h: float = 168.0) -> Column:
    """Halves every ``half_life_h`` hours; unknown times get 0.5 and future ones 1."""
    age = F.greatest(hours_between(now, ts), F.lit(0.0))
    return F.when(_c(ts).isNull(), 0.5).otherwise(F.pow(F.lit(0.5), age / F.lit(max(half_life_h, 1e-6))))


def day_from_ts(ts, tz: str = "America/New_York") -> Column:
    return F.to_date(F.from_utc_timestamp(_c(ts), tz))


def has_han(col) -> Column:
    return F.regexp_like(_c(col), F.lit(r"\p{IsHan}"))


def has_french(col) -> Column:
    return F.regexp_like(_c(col), F.lit(FRENCH_MARKS))


def role_display(col, names: dict[str, str] | None = None) -> Column:
    """Display name of a role; unknown roles stay as they are."""
    names = names or {"user": "User", "assistant": "Assistant"}
    out = _c(col)
    for role, shown in names.items():
        out = F.when(_c(col) == role, F.lit(shown)).otherwise(out)
    return out
