"""Personal data in plain and disguised form, with offsets in the source text.

Plain identifiers are found in the text as it is. Disguised ones are found in normalised views of it. A view is
made by a transducer: a list of edits (start, end, replacement) of the source, from homoglyphs and invisible
characters, at/dot disguises and spelled digits. It keeps, for every edit, where it lies on both sides, so a span found
in the view maps back to the source characters that produced it. A view's span counts if an edit lies in it.

Clean prose is left alone: a bare "at" counts only with a spelled dot and a common top-level domain after
it, and digits must still make up a whole address, card number (Luhn) or international phone number. For the same reason a
disguise is one of limited looseness: at most 8 white-space characters beside a disguised sign, 64 characters before
it, 6 labels after it, 4 signs between digits. Plain identifiers have no such limits.

Edge cases. Null or empty text: no spans. Repeated rows: each is scanned. Very long texts: every pass is linear
in the text. Empty table: empty result. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
_LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ӏ": "l", "ь": "b", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ӏ": "I", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "τ": "t", "χ": "x", "γ": "y", "ε": "e", "η": "n", "ω": "w", "σ": "o", "μ": "u",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ʟ": "l", "ո": "n", "օ": "o", "ս": "u", "ց": "g", "հ": "h", "ｌ": "l",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "‧": ".", "·": ".", "∙": ".", "•": ".", "⋅": ".", "٫": ".", "۔": ".", "⁎": "*", "⊕": "+", "➕": "+", "☎": "",
}
# Digits in words, English, French, German and Spanish, with what is spelled between them.
_DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SIGNS = {"plus": "+", "más": "+", "mas": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "hyphen": "-", "minus": "-", "space": " "}
_TIMES = {"double": 2, "triple": 3}
# Endings that a bare "at ... dot ..." must have.
_ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|io|ai|co|me|tv|us|uk|de|fr|es|it|nl|be|ch|at|eu|pl|se|no|fi|dk|pt|cz|ru|ua|ca|mx|br|ar|cl|jp|cn|in|kr|au|nz|za|example|test|invalid|local|online|site|shop|cloud|email|mail"
# All country endings and more general ones; after "dot" alone, as "point" stands in prose ("at this point to").
_MORE_ENDINGS = _ENDINGS + "|" + "|".join(
    "ac ad ae af ag al am ao aq as aw ax az ba bb bd bf bg bh bi bj bm bn bo bs bt bw by bz cc cd cf cg ci ck cm cr cu cv cw cx cy dj dm do dz ec ee eg er et fj fk fm fo ga gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im iq ir is je jm jo ke kg kh ki km kn kp kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw my mz na nc ne nf ng ni np nr nu om pa pe pf pg ph pk pm pn pr ps pw py qa re ro rs rw sa sb sc sd sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tw tz ug uy uz va vc ve vg vi vn vu wf ws ye yt zm zw xyz top club live news blog tech store agency studio world space website systems solutions services digital network group team academy health museum coop aero jobs mobi travel tel cat asia post".split()
)
_END = r"\s{1,8}(?:dot\s{1,8}(?:" + _MORE_ENDINGS + r")|(?:punkt|point|punto)\s{1,8}(?:" + _ENDINGS + r"))(?![A-Za-z0-9-])"

_ODD = re.compile("[\x80-\x9f\xa0\xaa\xad\xb2\xb3\xb7\xb9\xbaıɐ-\U0010ffff]")
_AT_WORD, _DOT_WORD = r"(?:at|arroba|arobase|ät|klammeraffe|a|@)", r"(?:dot|punkt|point|punto|period|\.)"
_AT = re.compile(r"\s{0,8}(?:[\[({<|]\s{0,8}" + _AT_WORD + r"\s{0,8}[\])}>|]|&#64;|&#x40;|&commat;|%40)\s{0,8}|(?<=\w)\s{0,8}[_*~]{1,3}at[_*~]{1,3}\s{0,8}(?=\w)|(?<=[\w])\s{1,8}@\s{0,8}(?=[\w])|(?<=[\w])@\s{1,8}(?=[\w])", re.I)
_DOT = re.compile(r"\s{0,8}(?:[\[({<|]\s{0,8}" + _DOT_WORD + r"\s{0,8}[\])}>|]|&#46;|&#x2e;|&period;|%2e)\s{0,8}|(?<=\w)\s{0,8}[_*~]{1,3}dot[_*~]{1,3}\s{0,8}(?=\w)", re.I)
_BARE_DOT = re.compile(r"\s{1,8}(?:dot|punkt|point|punto|\.)\s{1,8}(?=[A-Za-z0-9-]+)", re.I)
_BARE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:\s{1,8}(?:dot|punkt|point|punto)\s{1,8}[A-Za-z0-9_%+-]{1,64}){0,4}?(\s{1,8}(?:at|arroba|arobase)\s{1,8})[A-Za-z0-9-]{1,63}(?:(?:\s{1,8}(?:dot|punkt|point|punto)\s{1,8}|\.)[A-Za-z0-9-]{1,63}){0,5}" + _END, re.I)
_AT_HINT = re.compile(r"[\[({<|&%_*~@](?:(?<=[\[({<|])\s{0,8}(?:a|ä|k|@)|(?<=&)(?:#64|#x40|commat)|(?<=%)40|(?<=[_*~])at[_*~]|(?<=\s@)|(?<=@)\s)")
_DOT_HINT = re.compile(r"[\[({<|&%.](?:(?<=[\[({<|])\s{0,8}[dp.]|(?<=&)(?:#46|#x2e|period)|(?<=%)2e|(?<=\s\.)\s)")
_DOT_WORDS = ("dot", "punkt", "point", "punto", "period")
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?:\s{1,8}(?:dot|punkt|point|punto|\.)\s{1,8}|\.)[A-Za-z0-9-]{1,63}){0,4}(?:" + _END + r"|\s{1,8}\.\s{1,8}(?:" + _ENDINGS + r")(?![A-Za-z0-9-]))", re.I)
_WORD = "|".join(sorted([*_DIGIT_WORDS, *_SIGNS, *_TIMES], key=len, reverse=True))
_SPELLED = re.compile(rf"(?<!\w)(?:{_WORD}|\+?[0-9]+)(?:[\s,;./_-]{{1,4}}(?:{_WORD}|[0-9]+))+(?!\w)", re.I)
_TOKEN = re.compile(rf"{_WORD}|\+?[0-9]+", re.I)
_DIGIT_WORD = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPELLED_HINT = re.compile(rf"(?:{_DIGIT_WORD})[\s,;./_-]{{1,4}}(?:{_WORD}|[0-9])|[0-9][\s,;./_-]{{1,4}}(?:{_DIGIT_WORD})")
_ADDRESS = re.compile(r"[0-9]+(?:\.[0-9]+){3}").fullmatch
_POINTED = re.compile(r"[0-9](?:\s{1,4}(?:dot|point|punkt|punto)\s{1,4}|\.)[a-z0-9]")
_BYTE_WORDS = {w.encode() for w in _DIGIT_WORDS}
_BREAKS = bytes(32 if c < 128 and not chr(c).isalnum() else c for c in range(256))
#: Letters that stand for a digit, in a word that has digits.
_LETTER_DIGITS = re.compile(r"(?<![A-Za-z0-9])(?=[0-9OoIl|]*[0-9])[0-9OoIl|]*[OoIl|][0-9OoIl|]*(?![A-Za-z0-9])")

_LETTER_HINT = re.compile(r"[0-9](?:(?=[OoIl|])|(?<=[OoIl|][0-9]))")
_DOTTED_HINT = re.compile(r"[\[({<]\s{0,8}(?:dot|\.)")

Span = tuple[str, int, int]


def _plain(char: str) -> str:
    """What a character stands for in an identifier; itself if nothing else."""
    if char in _LOOKALIKES:
        return _LOOKALIKES[char]
    if unicodedata.category(char) in ("Cf", "Mn", "Cc"):  # invisible, or a mark on the letter before
        return ""
    if (digit := unicodedata.decimal(char, None)) is not None or (digit := unicodedata.digit(char, None)) is not None:
        return str(digit)
    same = unicodedata.normalize("NFKC", char)
    return same if same.isascii() and len(same) == 1 else char


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """Identifiers as they stand, leftmost and non-overlapping for each kind, by kind and start."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append(("email", start, done := m.end()))
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append(("phone", *m.span()))
    return found


class View:
    """A text with edits applied, and the way back."""

    def __init__(self, text: str, edits: list[tuple[int, int, str]]):
        parts, self.edits, at, out = [], [], 0, 0
        for start, end, new in sorted(edits, key=lambda e: (e[0], -e[1])):
            if start < at or text[start:end] == new:
                continue  # an edit inside another
            parts += [text[at:start], new]
            out += start - at
            self.edits.append((out, out + len(new), start, end))
            out, at = out + len(new), end
        parts.append(text[at:])
        self.text, self.starts = "".join(parts), [e[0] for e in self.edits]

    def source(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source characters of view[start:end], and whether an edit lies in them."""
        i = bisect_right(self.starts, start) - 1
        while i > 0 and self.edits[i][0] == start and self.edits[i][0] == self.edits[i][1] and self.edits[i - 1][0] == start:
            i -= 1
        first = start
        if i >= 0:
            a, b, x, y = self.edits[i]
            first = x if start < b else y + start - b
        j = bisect_right(self.starts, end - 1) - 1
        last = end
        if j >= 0:
            a, b, x, y = self.edits[j]
            last = y if end <= b else y + end - b
        k = bisect_right(self.starts, start - 1)  # an edit that starts in the span, or one that reaches into it
        edited = k < len(self.edits) and self.edits[k][0] < end and not (self.edits[k][0] == self.edits[k][1] == start) or k > 0 and self.edits[k - 1][1] > start
        if not edited:
            edited = any(start < a < end for a in self.starts[k : k + 2])
        return first, last, edited


def _spelled(text: str) -> str:
    out, times, at = "", 1, 0
    for token in _TOKEN.finditer(text):
        word = token[0].lower()
        if text[at : token.start()] == "." and out[-1:].isdigit():
            out += "."
        at = token.end()
        if word in _TIMES:
            times = _TIMES[word]
            continue
        out += _DIGIT_WORDS.get(word, _SIGNS.get(word, word)) * times
        times = 1
    return out


def _numbers(match: re.Match, least: int) -> list[tuple[int, int, str]]:
    """One edit for a run with ``least`` digit words that spells at least four digits, or for an address."""
    words = [t.lower() for t in _TOKEN.findall(match[0])]
    spelled = _spelled(match[0])
    enough = sum(w in _DIGIT_WORDS for w in words) >= least and sum(c.isdigit() for c in spelled) >= 4
    return [(*match.span(), spelled)] if spelled != match[0] and (enough or _ADDRESS(spelled)) else []


def _characters(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain(m[0])) != m[0]]


def _disguises(text: str) -> list[tuple[int, int, str]]:
    """At and dot disguises: wrapped ones anywhere, bare ones only where a whole address is spelled."""
    edits = [(*m.span(), "@") for m in _AT.finditer(text)]
    for m in _BARE.finditer(text):
        edits.append((*m.span(1), "@"))
        edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.start(), m.end())]
    if edits:
        edits += [(*m.span(), ".") for m in _DOT.finditer(text)]
        near = [e[1] for e in edits if e[2] == "@"]
        for at in near:  # after a disguised at, dots may be spelled bare, up to a common ending
            if m := _HOST.match(text, at):
                edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, m.start(), m.end())]
    elif "@" in text:
        edits += [(*m.span(), ".") for m in _DOT.finditer(text)]
        for m in re.finditer(r"(?<=[A-Za-z0-9._%+-]@)(?=[A-Za-z0-9-])", text):
            if host := _HOST.match(text, m.start()):
                edits += [(d.start(), d.end(), ".") for d in _BARE_DOT.finditer(text, host.start(), host.end())]
    return edits


def _composed(outer: View, inner: View, span: Span) -> tuple[Span, bool]:
    """A span of ``inner``, a view of ``outer``'s text, in the source of ``outer``."""
    start, end, a = inner.source(span[1], span[2])
    start, end, b = outer.source(start, end)
    return (span[0], start, end), a or b


def _spells(low: str) -> bool:
    """Whether a digit word may stand beside another one or a digit."""
    words = low.encode("utf-8", "replace").translate(_BREAKS).split()
    return not _BYTE_WORDS.isdisjoint(words) and _SPELLED_HINT.search(low) is not None


def disguised_spans(text: str) -> list[Span]:
    """Identifiers that only the normalised views show."""
    odd = not text.isascii() and _ODD.search(text) is not None
    base = View(text, _characters(text) if odd else [])
    plain, found = base.text, set()
    low = plain.lower()
    dotted = any(w in low for w in _DOT_WORDS)
    if odd or _AT_HINT.search(low) or ("@" in low or dotted and ("at" in low or "arroba" in low)) and (dotted or _DOT_HINT.search(low)):
        view = View(plain, _disguises(plain))
        if base.edits or view.edits:
            found |= {s for x in plain_spans(view.text) if x[0] == "email" for s, edited in [_composed(base, view, x)] if edited}
    runs = list(_SPELLED.finditer(plain)) if _spells(low) or (dotted or low.count(".") >= 3) and _POINTED.search(low) else []
    dots = [(*m.span(), ".") for m in _DOT.finditer(plain) if m.start() and m.end() < len(plain) and plain[m.start() - 1].isdigit() and plain[m.end()].isdigit()] if _DOTTED_HINT.search(low) else []
    letters = [(m.start() + i, m.start() + i + 1, "0" if c in "Oo" else "1") for m in _LETTER_DIGITS.finditer(plain) for i, c in enumerate(m[0]) if c in "OoIl|"] if _LETTER_HINT.search(plain) else []
    edits = [e for m in runs for e in _numbers(m, 3)]
    looser = [e for m in runs for e in _numbers(m, 1)]
    # a digit word of prose beside a number must not hide what the view without it shows
    for numbers in [edits] + [looser] * (looser != edits) if base.edits or edits or looser or dots or letters else []:
        view = View(plain, numbers + dots + letters)
        found |= {s for x in plain_spans(view.text) if x[0] != "email" for s, edited in [_composed(base, view, x)] if edited}
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1:]))


def all_spans(text: str | None) -> tuple[list[Span], list[Span]]:
    """(plain spans, plain and disguised ones), each by kind, start and end."""
    if not text:
        return [], []
    plain = plain_spans(text)
    return plain, sorted({*plain, *disguised_spans(text)}, key=lambda s: (KINDS.index(s[0]), s[1:]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str | None, mark: str = "<{}>") -> str | None:
    """The text with every identifier replaced by its kind; overlapping ones by the first one's."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, end in sorted(all_spans(text)[1], key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], mark.format(kind.upper())]
        elif end > at:
            pass
        at = max(at, end)
    return "".join([*parts, text[at:]])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, base counts, digest of the base spans, all spans, and how many of them only the views show."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                plain, spans = all_spans(text.as_py())
                counts = [sum(s[0] == k for s in plain) for k in KINDS]
                for col, x in zip(cols, [*counts, hashlib.sha256(joined(plain).encode()).hexdigest(), joined(spans), len(spans) - len(plain)], strict=True):
                    col.append(x)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_disguised"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with identifiers masked in the text, and n_chars, where there is one, counted anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked(t.as_py()) for t in batch.column("text")]
            new = {"text": pa.array(texts, pa.string())}
            if "n_chars" in batch.schema.names:
                new["n_chars"] = pa.array([None if t is None else len(t) for t in texts], batch.schema.field("n_chars").type)
            yield pa.record_batch([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
