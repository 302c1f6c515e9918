"""Text functions as columns: tokens, wildcards, stems, dates, escapes."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What separates terms: anything but letters and numbers.
BREAK = r"[^\p{L}\p{N}]+"
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"

#: A short list of function words; callers pass their own where they need another.
STOP_WORDS = tuple("a an and are as at be but by for from has have in is it its of on or that the this to was were will with".split())
DATE_FORMATS = ("MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd MMM yyyy HH:mm:ss", "dd MMM yyyy", "yyyyMMdd")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cased_tokens(text) -> Column:
    """Array of terms as written; a null text has none."""
    return F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), BREAK), "")


def tokens(text) -> Column:
    """Array of lower-cased terms."""
    return cased_tokens(F.lower(_col(text)))


def query_tokens(text: str) -> list[str]:
    """The terms of a query string, as `cased_tokens` cuts texts."""
    out, held = [], []
    for ch in text:
        if ch.isalnum():
            held.append(ch)
        elif held:
            out.append("".join(held))
            held = []
    return out + ["".join(held)] if held else out


def universal_tokens(text) -> Column:
    """Lower-cased terms; a run of CJK characters XYZ becomes 0X X XY Y YZ Z Z0."""

    def grams(run: Column) -> Column:
        n = F.length(run)
        at = lambda i: F.substring(run, i, F.lit(1))
        body = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.when(i < n, F.array(at(i), F.concat(at(i), at(i + 1)))).otherwise(F.array(at(i)))))
        return F.concat(F.array(F.concat(F.lit("0"), at(F.lit(1)))), body, F.array(F.concat(at(n), F.lit("0"))))

    runs = F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(f"[{CJK}]+|[\\p{{L}}\\p{{N}}&&[^{CJK}]]+"), F.lit(0))
    return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^[{CJK}]"), grams(r)).otherwise(F.array(r))))


def wildcard(pattern: str) -> str:
    """An anchored regular expression of a pattern with * and ?."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def is_wildcard(text: str) -> bool:
    return "*" in text or "?" in text


def shared_prefix(a, b: str) -> Column:
    """Length of the longest common beginning of a column and a word."""
    c = _col(a)
    return F.greatest(F.lit(0), *[F.when(c.startswith(b[:k]), k).otherwise(0) for k in range(1, len(b) + 1)]) if b else F.lit(0)


def stem_ratio(a, b: str) -> Column:
    """Shared beginning over the longer length."""
    return shared_prefix(a, b) / F.greatest(F.length(_col(a)), F.lit(len(b)))


def bigrams(word) -> Column:
    """Distinct character pairs of a word."""
    c = _col(word)
    return F.array_distinct(F.when(F.length(c) < 2, F.array(c)).otherwise(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))))


def html_encode(text) -> Column:
    out = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def html_decode(text) -> Column:
    out = _col(text)
    for b, a in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        out = F.replace(out, F.lit(b), F.lit(a))
    return out


def string_escape(text) -> Column:
    return F.replace(F.replace(F.replace(_col(text), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def parse_date(text, now: Column | None = None) -> Column:
    """Timestamp of a date string: the first of DATE_FORMATS that fits; now, today, 0 and
    never (the epoch), and +n or -n days from now."""
    c = F.trim(_col(text))
    now = F.current_timestamp() if now is None else now
    days = F.regexp_extract(c, r"^([+-]\d+)$", 1).try_cast("int")
    word = (
        F.when(F.lower(c) == "now", now)
        .when(F.lower(c) == "today", F.date_trunc("day", now))
        .when((c == "0") | (F.lower(c) == "never"), F.timestamp_seconds(F.lit(0)))
        .when(days.isNotNull(), now + F.make_dt_interval(days))
    )
    return F.coalesce(word, *[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def at_midnight(ts) -> Column:
    return F.date_trunc("day", _col(ts)) == _col(ts)


def log_add(a, b) -> Column:
    """ln(e^a + e^b) without leaving the log domain."""
    hi, lo = F.greatest(_col(a), _col(b)), F.least(_col(a), _col(b))
    return hi + F.log1p(F.exp(lo - hi))


# ---- token pipelines: array -> array


def drop_stop_words(toks: Column, words=STOP_WORDS) -> Column:
    """Without stop words, terms of over 30 characters and terms with digits."""
    return F.filter(toks, lambda t: ~t.isin(*words) & (F.length(t) <= 30) & ~t.rlike(r"\d"))


def drop_numbers(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~t.rlike("^[0-9]+$"))


def replace_tokens(toks: Column, words: dict[str, str]) -> Column:
    if not words:
        return toks
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(table, t), t))


QUESTION_WORDS = tuple("who what when where why how which is are can could do does did will would should".split())


def questions(text, starters=QUESTION_WORDS, most: int = 75) -> Column:
    """The questions of a text: from a starter word to the next ?, most words at most."""
    return F.regexp_extract_all(_col(text), F.lit(rf"(?i)\b(?:{'|'.join(starters)})\b(?:[^\s.?!]*[\s,;:]+){{0,{most - 1}}}?[^\s.?!]*\?"), F.lit(0))


def pipeline(text, preset: str = "lc", stop_words=STOP_WORDS) -> Column:
    """Terms by a preset: cased, uncased, uncased_stop, lc, lc_stem, lc_stop."""
    if preset == "cased":
        return cased_tokens(text)
    toks = tokens(text)
    if preset in ("uncased", "lc"):
        return toks
    if preset in ("uncased_stop", "lc_stop"):
        return drop_stop_words(toks, stop_words)
    if preset == "lc_stem":
        from .stem import porter_tokens

        return porter_tokens(toks)
    raise ValueError(f"unknown preset {preset}")


# ---- analyzers: how an indexed text and the words of a query become terms

_RUNS = regex.compile(r"(?V1)[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]+|[[\p{L}\p{N}]--[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]]+")
_CJK_RUN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}]")


def universal_words(text: str) -> list[str]:
    """A query's terms, in a row as `universal_tokens` has them, but for the marks of where
    its first run begins and its last one ends: a text may go on there."""
    runs = _RUNS.findall(text.lower())
    out: list[str] = []
    for k, run in enumerate(runs):
        if not _CJK_RUN.match(run):
            out.append(run)
            continue
        if k:
            out.append("0" + run[0])
        if len(run) == 1:
            out.append(run)
        for a, b in zip(run, run[1:], strict=False):
            out += [a, a + b]
        if len(run) > 1:
            out.append(run[-1])
        if k + 1 < len(runs):
            out.append(run[-1] + "0")
    if len(runs) == 1 and len(out) > 2:  # one run: its first and last letters are in pairs
        out = out[1:-1]
    return out


@dataclass(frozen=True)
class Analyzer:
    """column: text column -> array of terms; words: text of a query -> its terms."""

    column: Callable[[Column], Column]
    words: Callable[[str], list[str]]


def _stopped(text: str) -> list[str]:
    words = (w.lower() for w in query_tokens(text))
    return [w for w in words if w not in STOP_WORDS and len(w) <= 30 and not re.search(r"\d", w)]


def _stemmed(text: str) -> list[str]:
    from .stem import porter

    return [porter(w) for w in query_tokens(text)]


ANALYZERS: dict[str, Analyzer] = {
    "": Analyzer(cased_tokens, query_tokens),
    "universal": Analyzer(universal_tokens, universal_words),
    "stop": Analyzer(lambda c: pipeline(c, "lc_stop"), _stopped),
    "stem": Analyzer(lambda c: pipeline(c, "lc_stem"), _stemmed),
}


def register_analyzer(name: str, column: Callable[[Column], Column], words: Callable[[str], list[str]] = query_tokens) -> None:
    """A user's own analyzer, for fields that name it. An index that is saved and loaded
    elsewhere needs it registered there as well."""
    ANALYZERS[name] = Analyzer(column, words)


def stop_in_field(toks: Column, field, only: str = "review", words=STOP_WORDS) -> Column:
    """Terms without stop words where they come from one field; others as they are."""
    return F.when(F.lower(_col(field)) == only.lower(), drop_stop_words(toks, words)).otherwise(toks)
