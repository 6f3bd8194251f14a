"""Personal data replaced by keyed surrogates of the same type and format.

Digits become digits, letters letters of the same script and case, marks stay;
networks, country codes, top-level domains and check digits stay valid. The
replacement is a keyed permutation of all strings of the entity's shape, made of
one cycle (a keyed step between a Feistel network with cycle walking and its
inverse), so equal entities get equal surrogates everywhere, different entities of
one shape can't meet, and none is its own. Names are drawn from lists by gender and
script, or made up for names not in the lists; here two names may meet, so all
names of the corpus are checked and later ones drawn again.

Entities are found once and stand beside the texts in a table between the steps.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.llm import _text
from glyphmill.llm._shared import col, cut, free_names, map_rows
from glyphmill.ship import ship

NAMES = {
    ("latin", "f"): "Alice Amelia Anna Barbara Camille Carla Carmen Caroline Charlotte Chloe Clara Diana Elena Eleanor Elisabeth Emily Emma Eva Florence Grace Hannah Helen Ines Irene Isabel Jane Julia Karin Laura Lea Linda Lucia Maria Martha Mary Monika Nora Olivia Paula Petra Rosa Ruth Sabine Sarah Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Albert Alexander Andrew Anton Antonio Arthur Bernard Carlos Charles Daniel David Edward Emil Felix Francis Frank Frederick George Hans Henry Hugo James Jan John Jorge Joseph Juan Karl Leo Louis Lucas Luis Marc Martin Max Michael Miguel Oliver Oscar Otto Patrick Paul Pedro Peter Philip Pierre Robert Simon Stefan Thomas Victor Walter William".split(),
    ("cyrillic", "f"): "Алла Анна Валентина Вера Галина Дарья Екатерина Елена Зоя Ирина Лариса Людмила Мария Надежда Наталья Нина Ольга Полина Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Василий Виктор Владимир Григорий Дмитрий Иван Игорь Константин Михаил Николай Олег Павел Пётр Роман Сергей Фёдор Юрий".split(),
}
_GIVEN = {n.lower(): key for key, names in NAMES.items() for n in names}
_TITLES = {
    **dict.fromkeys("mr herr señor monsieur don господин г-н κύριος السيد".split(), "m"),
    **dict.fromkeys("mrs ms miss frau señora señorita madame mme mlle doña госпожа г-жа κυρία السيدة".split(), "f"),
    **dict.fromkeys("dr prof doctor الدكتور".split(), ""),
}
_SYLLABLES = {
    "latin": [a + b for a in "b c d f g h k l m n p r s t v w".split() for b in "a e i o u al an ar el en er in or on".split()],
    "cyrillic": [a + b for a in "б в г д ж к л м н п р с т".split() for b in "а е и о у ан ар ен ер ин ов".split()],
    "greek": [a + b for a in "β γ δ θ κ λ μ ν π ρ σ τ φ χ".split() for b in "α ε η ι ο ου αν αρ ελ εν ιν ορ".split()],
}
#: Letters of made-up names, as many as the name has.
_LETTERS = {
    "han": "安白柏博晨成达德方飞芳峰福刚国海涵浩和红宏华慧佳建江杰静君凯兰乐丽林玲龙梅美敏明宁平琴清荣蓉瑞山胜思涛婷文雪雅阳瑶颖宇玉媛云志",
    "arabic": "ابتثجحخدذرزسشصضطعغفقكلمنهوي",
    "hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "kana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "hangul": "가경광규기나남다대도동라미민박배범보빈상서석선성세소수승시아영예오용우원유윤은인일재정제종주준지진창채철태하한현형혜호홍환희",
}
_WORD = r"[^\W\d_]"
_NAME = rf"{_WORD}+(?:-{_WORD}+)?"
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?<!\w)AKIA[0-9A-Z]{16}(?!\w)|(?<!\w)(?i:password|passwd|pwd|secret|token|api[_-]?key)\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[\w+/-]{8,})",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,4}(?:\d{3})?(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.(+-])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.+-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "name": rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, (t[0].upper() + t[1:] for t in _TITLES)), key=len, reverse=True))})\.? (?P<names>{_NAME}(?: (?:{_WORD}\.(?= )|{_NAME})){{0,4}})(?!\w)",
}
_ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: No entity but a name without a title is in a text without one of these (RE2's syntax).
HINT = rf"[0-9@]|::|(?:[A-Fa-f]{{1,4}}:){{7}}|(?:{'|'.join(sorted((t[0].upper() + t[1:] for t in _TITLES), key=len, reverse=True))})\.? |[Kk][Ee][Yy]|(?i:passw|pwd|secret|token)"
_HINT = re.compile(HINT)

#: Scripts that don't part words.
_UNSPACED = ("han", "kana", "thai", "lao", "khmer", "myanmar")
_UPPER = "A-ZÀ-ÖØ-ÞА-ЯЁ"
_PART = re.compile(rf"{_WORD}\.(?= )|{_NAME}")
_PAIR = re.compile(rf"[{_UPPER}]{_WORD}+(?= [{_UPPER}])")
_AFTER = re.compile(rf"{_NAME}(?: (?:{_WORD}\.(?= )|{_NAME})){{1,4}}(?!\w)")


class Keyed:
    """Keyed permutations."""

    def __init__(self, key: bytes):
        self.key = key
        self.known: dict[tuple, str] = {}

    def number(self, *parts: str) -> int:
        return int.from_bytes(hmac.new(self.key, "\0".join(parts).encode("utf-8", "surrogatepass"), hashlib.sha256).digest()[:8], "big")

    def _shuffle(self, x: int, n: int, tweak: str, back: bool) -> int:
        """A permutation of 0 .. n - 1 or its inverse: Feistel rounds, again while
        they lead out of the range."""
        half = ((n - 1).bit_length() + 1) // 2
        size = (half + 7) // 8
        mask = (1 << half) - 1
        while True:
            left, right = x >> half, x & mask
            for i in range(5, -1, -1) if back else range(6):
                if back:
                    left, right = right, left
                seed = f"{tweak}|{i}|".encode() + right.to_bytes(size, "big")
                left ^= int.from_bytes(hashlib.shake_256(self.key + b"|" + seed).digest(size), "big") & mask
                if not back:
                    left, right = right, left
            x = left << half | right
            if x < n:
                return x

    def permute(self, x: int, n: int, tweak: str) -> int:
        """A permutation of 0 .. n - 1, chosen by key and tweak, that leaves nothing
        in its place unless n is 1."""
        if n < 2:
            return x
        step = 1 + self.number(tweak, str(n)) % (n - 1)
        return self._shuffle((self._shuffle(x, n, tweak, False) + step) % n, n, tweak, True)

    def reshape(self, text: str, tweak: str, hexadecimal: bool = False) -> str:
        """Another string of the same shape: letters and digits permuted as one
        number of mixed radix, all other characters as they are."""
        sets = []
        for c in text:
            if hexadecimal and c in "0123456789abcdef":
                sets.append("0123456789abcdef")
            elif "0" <= c <= "9":
                sets.append("0123456789")
            elif "a" <= c <= "z":
                sets.append("abcdefghijklmnopqrstuvwxyz")
            elif "A" <= c <= "Z":
                sets.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            elif "а" <= c <= "я":
                sets.append("абвгдежзийклмнопрстуфхцчшщъыьэюя")
            else:
                sets.append(c)
        x, n = 0, 1
        for c, s in zip(text, sets, strict=True):
            x, n = x * len(s) + s.index(c), n * len(s)
        shape = "".join(s if len(s) == 1 else s[0] for s in sets)
        x = self.permute(x, n, f"{tweak}|{shape}")
        out = []
        for s in reversed(sets):
            x, r = divmod(x, len(s))
            out.append(s[r])
        return "".join(reversed(out))

    def name(self, script: str, gender: str, name: str, attempt: int) -> str:
        """A lower-case name for a lower-case name."""
        pool = NAMES.get((script, gender)) if gender else None
        if pool and name in _GIVEN and _GIVEN[name] == (script, gender) and not attempt:
            order = sorted(n.lower() for n in pool)
            return order[self.permute(order.index(name), len(order), f"given|{script}|{gender}")]
        parts = _SYLLABLES.get(script) or _letters(script, name)
        x = self.number("name", script, gender, name, str(attempt))
        out = []
        # ever longer after some draws, so that names can't run out
        for _ in range((3 if script in _SYLLABLES else len(name)) + attempt // 3):
            x, r = divmod(x, len(parts))
            out.append(parts[r])
        return "".join(out) + (("а" if script == "cyrillic" else "a") if gender == "f" and pool else "")


def _luhn(digits: str) -> int:
    """The check digit to follow these digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _script(word: str) -> str:
    kind = unicodedata.name(word[0], "OTHER").split()[0].split("-")[0].lower()
    return {"cjk": "han", "hiragana": "kana", "katakana": "kana"}.get(kind, kind)


def _letters(script: str, name: str) -> str:
    """Letters for a name of a script without syllables; of one without a list those
    that stand about its own."""
    if script in _LETTERS:
        return _LETTERS[script]
    begin = ord(name[0]) & ~127
    return "".join(c for c in map(chr, range(begin, begin + 128)) if unicodedata.category(c) == unicodedata.category(name[0]))


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else "-".join(p[:1].upper() + p[1:] for p in word.split("-")) if like[0].isupper() else word


def _named(text: str, at: int, end: int, gender: str):
    """The entities of a name's words in text[at:end]: a first name, initials and
    listed given names in the middle, a last name."""
    words = []
    for w in _PART.finditer(text, at, end):
        i, j = w.span()
        middle = len(words) > 1 and (words[-1][2] is None or words[-1][3] is not None)
        cased = w[0][0].isupper() or w[0][0].islower()
        if w[0][0].islower() or len(words) > 1 and not middle or words and not cased:
            break
        if _script(w[0]) in _UNSPACED and j - i > 4:
            j = i + 3
        low = text[i:j].lower()
        initial = w[0].endswith(".")
        words.append((i, j, None if initial else low, None if initial else _GIVEN.get(low)))
        if not cased:  # of scripts without capitals the word after the title alone
            break
    while words and words[-1][2] is None:
        words.pop()
    for n, (i, j, low, given) in enumerate(words):
        if low is None:
            continue
        # the first of two names is a given name; one alone is a surname unless listed
        is_given = n == 0 and (given is not None or len(words) > 1) or 0 < n < len(words) - 1
        g = (given[1] if given else gender) if is_given else ""
        yield "name", i, j, f"{_script(low)}|{g}|{low}"


def find(text: str, hinted: bool | None = None):
    """(type, start, end, canonical form) of each entity in turn. The canonical
    form is what makes two mentions one entity: digits alone of numbers, lower
    case of addresses, of names script, gender and name, one for each name.

    Names are those after a title, those of a listed given name and a capitalised
    word, and every later or earlier capitalised mention of either in the text.
    ``hinted``: whether ``HINT`` is in the text, if that is known."""
    found = list(_marked(text)) if (_HINT.search(text) if hinted is None else hinted) else []
    for m in _PAIR.finditer(text):
        a = m.start()
        if m[0].lower() in _GIVEN and not (a and (text[a - 1].isalnum() or text[a - 1] in "_-")):
            whole = _AFTER.match(text, a)
            got = list(_named(text, a, whole.end(), "")) if whole else []
            if len(got) > 1:
                found += _free(found, got)
    names = {}
    for kind, a, b, c in found:
        if kind == "name" and b - a > 1:
            names.setdefault(text[a:b].lower(), c)
    if names:
        forms = {text[a:b] for k, a, b, _ in found if k == "name"} | {f for n in names for f in (_cased("X" + n[1:], n), n.upper())}
        forms = sorted(forms, key=len, reverse=True)
        apart, within = ([re.escape(f) for f in forms if (_script(f) in _UNSPACED) == u] for u in (False, True))
        again = re.compile("|".join([*([rf"(?<![\w-])(?:{'|'.join(apart)})(?![\w-])"] if apart else []), *within]))
        found += _free(found, [("name", *m.span(), names[m[0].lower()]) for m in again.finditer(text) if m[0].lower() in names])
    yield from sorted(found, key=lambda e: e[1])


def _free(found: list[tuple], more: list[tuple]) -> list[tuple]:
    """Those of ``more`` that overlap none found."""
    held = sorted((e[1], e[2]) for e in found)
    out = []
    for e in more:
        i = bisect.bisect_left(held, (e[2], 0))
        if i == 0 or held[i - 1][1] <= e[1]:
            out.append(e)
    return out


def _marked(text: str):
    """The entities that their form or a title tells."""
    for m in _ANY.finditer(text):
        kind = m.lastgroup if m.lastgroup in PATTERNS else next(k for k in PATTERNS if m.group(k) is not None)
        a, b = m.span()
        if kind == "name":
            yield from _named(text, *m.span("names"), _TITLES[m.group("title").lower()])
        elif kind == "secret":
            if m.group("value") is not None:
                a, b = m.span("value")
            yield kind, a, b, text[a:b]
        elif kind == "email":
            yield kind, a, b, text[a:b].lower()
        elif kind == "ip":
            yield kind, a, b, text[a:b]
        elif kind == "ipv6":
            try:
                yield kind, a, b, ipaddress.IPv6Address(text[a:b]).exploded
            except ValueError:
                continue
        elif kind == "iban":
            yield kind, a, b, text[a:b].replace(" ", "")
        else:
            digits = re.sub(r"\D", "", text[a:b])
            if kind == "phone" and not 8 <= len(digits) <= 15 or kind == "card" and not 13 <= len(digits) <= 19:
                continue
            yield kind, a, b, ("+" if text[a] == "+" else "") + digits


def surrogate(keyed: Keyed, kind: str, canonical: str, attempt: int = 0) -> str:
    """The canonical form of the entity's surrogate."""
    memo = (kind, canonical, attempt)
    got = keyed.known.get(memo)
    if got is not None:
        return got
    if kind == "name":
        script, gender, name = canonical.split("|")
        out = keyed.name(script, gender, name, attempt)
    elif kind == "email":
        head, dot, tld = canonical.rpartition(".")
        out = keyed.reshape(head, kind + tld) + dot + tld
    elif kind == "ip":
        a, rest = canonical.split(".", 1)
        b, c, d = map(int, rest.split("."))
        x = keyed.permute(b << 16 | c << 8 | d, 1 << 24, "ip" + a)
        out = f"{int(a)}.{x >> 16}.{x >> 8 & 255}.{x & 255}"
    elif kind == "ipv6":  # its first 16 bits stay
        net, rest = canonical[:4], canonical[4:].replace(":", "")
        digits = net + f"{keyed.permute(int(rest, 16), 1 << 112, 'ipv6' + net):028x}"
        out = ":".join(digits[i : i + 4] for i in range(0, 32, 4))
    elif kind == "card":
        body = canonical[1:-1]
        if _luhn(canonical[:-1]) == int(canonical[-1]):
            new = canonical[0] + keyed.reshape(body, "luhn" + canonical[0])
            out = new + str(_luhn(new))
        else:  # stays without a valid check digit, as it was
            off = (int(canonical[-1]) - _luhn(canonical[:-1])) % 10
            new = canonical[0] + keyed.reshape(body, f"card{canonical[0]}{off}")
            out = new + str((_luhn(new) + off) % 10)
    elif kind == "iban":
        country, rest = canonical[:2], canonical[4:]
        valid = _iban_check(country, rest) == canonical[2:4]
        new = keyed.reshape(rest, "iban" + country + ("" if valid else canonical[2:4]))
        out = country + (_iban_check(country, new) if valid else canonical[2:4]) + new
    elif kind == "phone":
        fixed = 2 if canonical[0] == "+" else 0  # the country code's first digit
        first = canonical[fixed]
        low = "01" if first in "01" else "23456789"
        rest = canonical[fixed + 1 :]
        x = low.index(first) * 10 ** len(rest) + int(rest)
        x = keyed.permute(x, len(low) * 10 ** len(rest), f"phone{canonical[:fixed]}{low[0]}{len(rest)}")
        lead, tail = divmod(x, 10 ** len(rest))
        out = canonical[:fixed] + low[lead] + str(tail).zfill(len(rest))
    elif kind == "ssn":
        out = keyed.reshape(canonical, kind)
    else:
        fixed = "AKIA" if re.fullmatch("AKIA[0-9A-Z]{16}", canonical) else ""
        rest = canonical[len(fixed) :]
        if fixed:
            x = keyed.permute(int(rest, 36), 36 ** len(rest), "akia")
            out = ""
            for _ in rest:
                x, r = divmod(x, 36)
                out = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[r] + out
            out = fixed + out
        else:
            out = keyed.reshape(rest, kind, hexadecimal=re.fullmatch("[0-9a-f]+", rest) is not None)
    if len(keyed.known) > 200_000:
        keyed.known.clear()
    keyed.known[memo] = out
    return out


def _fitted(kind: str, mention: str, new: str) -> str:
    """The surrogate in the mention's own format."""
    if kind == "name":
        return _cased(mention, new)
    if kind == "ipv6":
        return new if len(mention) == 39 else str(ipaddress.IPv6Address(new))
    if kind in ("card", "phone", "ssn"):
        digits = iter(new.lstrip("+"))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        chars = iter(new)
        return "".join(" " if c == " " else next(chars) for c in mention)
    if kind == "email":
        return "".join(n.upper() if c.isupper() else n for c, n in zip(mention, new, strict=True)) if len(mention) == len(new) else new
    return new


def replace(keyed: Keyed, text: str, again: dict[tuple[str, str], int], found: list[tuple] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the types replaced in turn. ``again``: which
    draw holds for entities whose first met another's; ``found``: the entities, if
    they are known."""
    out, at, kinds = [], 0, []
    for kind, a, b, canonical in find(text) if found is None else found:
        out += [text[at:a], _fitted(kind, text[a:b], surrogate(keyed, kind, canonical, again.get((kind, canonical), 0)))]
        at = b
        kinds.append(kind)
    return "".join(out) + text[at:] if kinds else text, kinds


_FOUND = "array<struct<kind:string,a:int,b:int,canonical:string>>"


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, all columns, with ``found`` (a free name; the last column) of
    what ``find`` finds; null where there is nothing."""
    fields = docs.schema.fields
    at = [f.name for f in fields].index(text_col)
    [name] = free_names(docs.columns, "found")
    kind = T._parse_datatype_string(_FOUND)
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("canonical", pa.string())]))

    def look(batches):
        for batch in batches:
            hinted = pc.match_substring_regex(batch.column(at), HINT).to_pylist()
            out = [[dict(zip(("kind", "a", "b", "canonical"), e, strict=True)) for e in find(t, h)] or None if t else None for t, h in zip(_text.each(batch.column(at)), hinted, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], [*(f.name for f in fields), name])

    return map_rows(docs, look, T.StructType([*fields, T.StructField(name, kind)]))


def collisions(found: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, attempt`` of the entities (kind, canonical) whose first
    surrogate is themselves or that of a lesser entity of their type: the draw at
    which they differ from all."""

    def draw(batches):
        keyed = Keyed(key.encode())
        for b in batches:
            kinds, cs, n = (x.to_pylist() for x in b.columns)
            new = [surrogate(keyed, k, c, i) for k, c, i in zip(kinds, cs, n, strict=True)]
            own = [k == "name" and x == c.rsplit("|", 1)[1] for k, c, x in zip(kinds, cs, new, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(new, pa.string()), pa.array(own, pa.bool_())], ["kind", "canonical", "attempt", "new", "own"])

    schema = "kind string, canonical string, attempt int, new string, own boolean"
    now = cut(found.distinct().select("kind", "canonical", F.lit(0).alias("attempt")).mapInArrow(draw, schema))
    while True:
        met = now.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canonical")).alias("first"), F.count("*").alias("n")).where("n > 1")
        late = now.join(met, ["kind", "new"], "left").where("own or canonical <> first.canonical")
        late = cut(late.select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")))
        if not late.limit(1).count():
            return now.where("attempt > 0").select("kind", "canonical", "attempt")
        now = cut(now.join(late, ["kind", "canonical"], "left_anti").union(late.mapInArrow(draw, schema)))


def surrogates(docs: DataFrame, key: str, text_col: str = "text", count_col: str = "n_entities", types_col: str = "entity_types", max_local: int = 500_000) -> DataFrame:
    """The documents with personal data in ``text_col`` replaced, and columns of
    how many entities were and of which types, in order of place; columns of
    these names already there are replaced.

    Found are e-mail and IP addresses (v4 and v6), phone, card, bank account and
    social security numbers, keys and passwords after their word, and names: after a
    title, as a listed given name and a capitalised word, and wherever a name so
    found stands again in the same text. Titles are in English, German, French,
    Spanish, Russian, Greek and Arabic; after one a name may be of any script, of
    those without capitals one word, of those without spaces 3 characters of a run
    of more than 4. Not found: people never titled whose given name isn't listed.
    A common word that is a name in the same text is replaced too.

    Equal entities get equal surrogates in all documents, different ones
    different surrogates, none its own. Null text stays null with count 0; all
    rows, repeated ones too, are treated alike; an empty table stays empty. ``key``
    is the secret from which the surrogates follow.

    Entities to be drawn again are few. Up to ``max_local`` go to every worker;
    beyond that each document gets its own by a join.
    """
    spark = docs.sparkSession
    ship(spark)
    rid, redraw = free_names([*docs.columns, "found", "found_"], "rid", "redraw")
    found = cut(entities(docs, text_col).withColumn(rid, F.monotonically_increasing_id()))
    name = found.columns[-2]
    seen = found.where(F.col(name).isNotNull()).select(rid, F.explode(name).alias("e")).select(rid, "e.kind", "e.canonical")
    again = cut(collisions(seen.select("kind", "canonical"), key))
    local = {}
    if again.limit(max_local + 1).count() <= max_local:
        local = {(r["kind"], r["canonical"]): r["attempt"] for r in again.collect()}
        found = found.withColumn(redraw, F.lit(None).cast("array<struct<kind:string,canonical:string,attempt:int>>"))
    else:
        per = seen.distinct().join(again, ["kind", "canonical"]).groupBy(rid).agg(F.collect_list(F.struct("kind", "canonical", "attempt")).alias(redraw))
        found = found.join(per, rid, "left")
    kept = [f for f in docs.schema.fields if f.name not in (count_col, types_col)]
    at = [f.name for f in kept].index(text_col)
    added = [T.StructField(count_col, T.IntegerType()), T.StructField(types_col, T.ArrayType(T.StringType()))]

    def rewrite(batches):
        keyed = Keyed(key.encode())
        for batch in batches:
            texts, counts, types = [], [], []
            for t, e, r in zip(_text.each(batch.column(at)), _text.each(batch.column(len(kept))), _text.each(batch.column(len(kept) + 1)), strict=True):
                own = {(x["kind"], x["canonical"]): x["attempt"] for x in r} if r else local
                new, kinds = replace(keyed, t, own, [(x["kind"], x["a"], x["b"], x["canonical"]) for x in e]) if e else (t, [])
                texts.append(new)
                counts.append(len(kinds))
                types.append(kinds)
            columns = batch.columns[: len(kept)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array(types, pa.list_(pa.string()))], [f.name for f in (*kept, *added)])

    return map_rows(found.select(*[col(f.name) for f in kept], name, redraw), rewrite, T.StructType([*kept, *added]))
