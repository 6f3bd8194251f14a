"""Tokenizers. All but the tweet tagger and the rules for runs are built-in
expressions; no pattern looks around, so that another engine's SQL can say the same."""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]+"


def whitespace(text: Column) -> Column:
    """Tokens between blanks; blank text has none."""
    return F.filter(F.split(text, BLANK), lambda x: x != "")


#: (pattern, replacement): ordered rewrites, then a split at blanks. Written for
#: one line at a time; groups are $1, $2 here and \\1, \\2 in the SQL.
BASIC = [
    ('(["“”„‟❝❞])', " $1 "),
    (r"\.{3}", " … "),
    (r"([*,:;@#&%$])", " $1 "),
    (r"([?¿!¡])", " $1 "),
    (r"([(){}\[\]<>])", " $1 "),
    (r"([^.…])\.(\s|$)", "$1 . $2"),
    ("…", "..."),
    ("--", " -- "),
]
TREEBANK = [
    (r'(^|[ (\[{<])"', "$1 `` "),
    (r"\.{3}", " … "),
    (r"([&%$#@:;,])", " $1 "),
    (r"""([^.…])\.([\])}>"']*) *$""", "$1 .$2 "),
    (r"([!?])", " $1 "),
    (r"([<>{}()\[\]])", " $1 "),
    ("…", "..."),
    ("--", " -- "),
    (r"^(.*)$", " $1 "),
    ('"', " '' "),
    (r"([^'])' ", "$1 ' "),
    (r"'(?i:(s|m|d)) ", " '$1 "),
    (r"(?i:('ll|'re|'ve|n't)) ", " $1 "),
    (r" (?i:(can)(not)) ", " $1 $2 "),
    (r" (?i:(gim|lem)(me)) ", " $1 $2 "),
    (r" (?i:(gon|wan)(na)) ", " $1 $2 "),
    (r" (?i:(got)(ta)) ", " $1 $2 "),
    (r" (?i:(more)('n)) ", " $1 $2 "),
    (r" (?i:(d')(ye)) ", " $1 $2 "),
    (r" (?i:('t)(is|was)) ", " $1 $2 "),
]
#: Frequent symbols and their plain spelling.
SYMBOLS = {
    "“": '"', "”": '"', "„": '"', "‘": "'", "’": "'", "–": "-", "—": "-", "―": "-", "…": "...", "«": "<<", "»": ">>", "•": "*", "°": "o",
    " ": " ", " ": " ", " ": " ", "​": " ", "̶": "-", "̸": "/", "̅": "-", "♥": "<3", "♡": "<3", "☺": ":)", "☹": ":(",
    "█": "||", "┃": "|", "─": "-", "━": "-", "═": "=", "▸": "=>", "▀": "^", "♪": " eighth-note ", "♫": " beamed-notes ", "★": " star ", "☀": " sun ", "☑": " checked ", "░": " shade ",
}
#: Runs of a mark or of laughter become a run that tells the class of their length.
_LENGTHS = ((54, "", 5), (18, 53, 4), (6, 17, 3), (3, 5, 2))
_RUNS = [
    *((f"{re.escape(c)}{{{lo},{hi}}}", c * n) for c in ".?!¡¿" for lo, hi, n in ((28, "", 5), (9, 27, 4), (4, 8, 3), (2, 3, 2))),
    *((f"(?i:[ea]?h)(?i:[eah]){{{lo},{hi}}}", "ha" * n) for lo, hi, n in _LENGTHS),
    *((f"(?i:j)(?i:[jea]){{{lo},{hi}}}", "ja" * n) for lo, hi, n in _LENGTHS),
    *((f"(?i:h+)(?i:m){{{lo},{hi}}}", "h" + "m" * n) for lo, hi, n in _LENGTHS),
    *((f"(?i:m){{{lo},{hi}}}", "m" * n) for lo, hi, n in _LENGTHS),
]
#: By way of private characters, so that no rule takes what another has made.
REPEATS = [*((p, chr(0xE000 + i)) for i, (p, _) in enumerate(_RUNS)), *((chr(0xE000 + i), new) for i, (_, new) in enumerate(_RUNS))]
_PYTHON_GROUP = re.compile(r"\$(\d)")


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, new)
    return text


def rewrite_sql(column: str, rules: list[tuple[str, str]]) -> str:
    """The same rewrites in DuckDB's SQL."""
    for pattern, new in rules:
        quoted = pattern.replace("'", "''"), _PYTHON_GROUP.sub(r"\\\1", new).replace("'", "''")
        column = f"regexp_replace({column}, '{quoted[0]}', '{quoted[1]}', 'g')"
    return column


def basic(line: Column) -> Column:
    """Conservative tokens for Western scripts; full stops part from words only
    at a blank or the end."""
    return whitespace(rewrite(line, BASIC))


def treebank(line: Column) -> Column:
    """Treebank-like tokens: directed quotes, split contractions, the line's last
    full stop apart."""
    return whitespace(rewrite(line, TREEBANK))


def symbols(text: Column) -> Column:
    """Frequent symbols in plain characters."""
    for c, new in SYMBOLS.items():
        text = F.replace(text, F.lit(c), F.lit(new))
    return text


def symbol_table(text: Column, table: dict[str, str]) -> Column:
    """Symbols by a table of hexadecimal code points, of any plane, and their
    spelling; read from lines of ``code,spelling`` by ``read_symbols``."""
    for code, new in table.items():
        text = F.replace(text, F.lit(chr(int(code, 16))), F.lit(new))
    return text


def read_symbols(lines: list[str]) -> dict[str, str]:
    return {code.strip(): new for code, _, new in (line.rstrip("\n").partition(",") for line in lines if line.strip() and not line.startswith("#"))}


def repeats(text: Column) -> Column:
    """Runs of marks and laughter by the class of their length. All rules go over a
    batch at once in linear time, which as many regexp_replace take long for."""
    rules = REPEATS

    @F.arrow_udf("string")
    def shortened(texts: pa.Array) -> pa.Array:
        for pattern, new in rules:
            # a private character stands for itself
            texts = (pc.replace_substring if len(pattern) == 1 else pc.replace_substring_regex)(texts, pattern, new)
        return texts

    return shortened(text)


#: One token and the character that ends it. A link is h, three characters, ":/".
TWEET_WORD = r"(h[^\n]{3}:/[^\p{Zs}\[]+|@[\p{Ll}\p{Lu}\p{Nd}_]*|#[\p{Ll}\p{Lu}\p{Nd}]*|[\p{Ll}\p{Lu}\p{Nd}]+)"


def tweet_words(text: Column) -> Column:
    """Words, @names, #topics and links; everything else parts them."""
    return F.regexp_extract_all(text, F.lit(TWEET_WORD), F.lit(1))


#: Spans of tweets in order of precedence; what no pattern takes goes to BASIC.
TAGS = [
    ("EMAIL", r"[\w.+-]+@\w[\w-]*(?:\.\w[\w-]*)+"),
    ("MENTION", r"(?<!\w)@\w+"),
    ("URL", r"(?:https?://|www\.)[^\s<>\"]+"),
    ("EMOTICON", r"(?<!\w)[<>]?[:;=8xX][-o^']?[)(\]\[dDpP/\\|*](?!\w)|(?<!\w)[(\[][-o^']?[:;=8]"),
    ("EASTERN", r"\((?:[\^\-~><TtoO0*]_?[._-]?[\^\-~><TtoO0*])\)|(?<!\w)[\^TtoO]_+[\^TtoO](?!\w)"),
    ("HEART", r"<+3+"),
    ("HASHTAG", r"(?<!\w)#\w+"),
    ("ARROW", r"<[-=]+|[-=]+>|[←→⇐⇒]"),
    ("REPEAT", r"([.?!¡¿])\1+|\b(?:[hj][aeh]){2,}h?\b|\bhm{2,}\b"),
    ("SYMBOL", r"[←-⯿\U0001f000-\U0001faff]"),
    ("NUMBER", r"(?<![\w.])[$€£]?[+-]?\d+(?:[.,:]\d+)*%?(?!\w)"),
]
_COMPILED = [(tag, re.compile(p)) for tag, p in TAGS]
_BASIC = [(re.compile(p), _PYTHON_GROUP.sub(r"\\\1", r)) for p, r in BASIC]


def tag_tweet(text: str | None) -> list[tuple[str, str, int]]:
    """(token, tag, start) of a tweet, tags by the first pattern that takes a
    span, the text left and right of it again by the later patterns. Starts
    count code points; null or blank text has no tokens."""
    out: list[tuple[str, str, int]] = []

    def plain(part: str, base: int) -> None:
        x = part
        for p, r in _BASIC:
            x = p.sub(r, x)
        at = 0
        for token in x.split():
            found = part.find(token, at)
            found = at if found < 0 else found
            out.append((token, "TOKEN", base + found))
            at = found + len(token)

    def spans(part: str, base: int, level: int) -> None:
        if not part.strip():
            return
        if level == len(_COMPILED):
            plain(part, base)
            return
        tag, pattern = _COMPILED[level]
        at = 0
        for m in pattern.finditer(part):
            spans(part[at : m.start()], base + at, level + 1)
            out.append((m.group(), tag, base + m.start()))
            at = m.end()
        spans(part[at:], base + at, level + 1)

    spans(text or "", 0, 0)
    return out


def tweet_tags(text: Column, as_tags: tuple[str, ...] = ()) -> Column:
    """array of (token, tag, start) as ``tag_tweet``; tokens of the kinds in
    ``as_tags`` are written as [KIND]."""

    @F.pandas_udf("array<struct<token:string,tag:string,start:int>>")
    def tag(texts):
        return texts.map(lambda t: [{"token": f"[{k}]" if k in as_tags else w, "tag": k, "start": s} for w, k, s in tag_tweet(t)])

    return tag(text)
