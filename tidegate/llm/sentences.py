"""Sentence units in many languages and scripts (problem 3).

A pushdown automaton walks the marks of a text (terminators, quotes, brackets, line breaks, list markers, Thai
spaces); the stack holds the open quotes and brackets, so a terminator inside a quotation never ends a unit, and the
list level decides whether a line start is an item. Abbreviations sit in a trie that is read backwards from the full
stop. Only marks are visited, never every character, so the cost is a few events per sentence.

Defined results: null or blank text has no unit; offsets are 0-based code points, ends exclusive; white space is in
no unit; the last unit ends with the last character that is not white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import regex as re

# Abbreviations by what may follow them. never: a sentence doesn't end here. number: it doesn't if a
# digit follows. end: it does if a capital follows.
NEVER = """dr prof mr mrs ms mx messrs capt lt col gen sgt rev hon st sr sra srta dra mme mlle m mm hr hrn frau fr dipl ing
dott dña d.ª g-n acc avda av calle c/ ave. blvd ул вул просп пер пл обл р-н им проф акад доц инж тов гос г-н г-жа п-н
डॉ प्रो श्री सुश्री कु श्रीमती ดร นพ พญ ผศ รศ e.g i.e z.b d.h p.ej p.ex vs z zzgl bzw sog ggf inkl exkl gem lt u.a i.d.r o.ä
ee напр например incl excl c.-à-d см див т.е т.к тобто notamment""".split()
NUMBER = """fig figs sec sect no nos nr num núm n nº art arts ch chap cap kap abb abs abschn vol p pp pg pág págs s seite eq eqs max min máx mín
approx aprox ca env circa ok ок бл рис стр гл п пп кв д корп буд с мал табл розд ред ст ver v сек мин सं पृ दि क्र จ พ.ศ ค.ศ ม.ค tel""".split()
END = """etc usw usf etw ltd inc corp co cie cía gmbh ag plc jr sen a.m p.m am pm u.k u.s u.s.a e.u uu ee.uu lbs lb cts ct oz ft pts pt ptas
dept ave incl. jan feb mar apr jun jul aug sep sept oct nov dec janv févr avr juil fev abr ago set dez ene abr dic mär okt dez
тыс млн млрд руб грн коп тис млрд г гг р рр ч др пр ін etc. bros est млн. ฯลฯ ex ej""".split()

_SPACE = frozenset("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“”", "«": "»", "»": "«", "‹": "›", "‘": "’", "‚": "‘’", '"': '"', "'": "'"}
_BRACKETS = frozenset("([{（【")
_CLOSERS = frozenset(")]}）】」』》〉”»›’\"'")
_WIDE = frozenset("。！？｡．")
_TERM = frozenset(".!?。．！？…।॥｡")
_EVENT = re.compile(r"""(?P<nl>\n)|(?P<term>[.!?。．！？…।॥｡]+)|(?P<mark>[()\[\]{}（）【】「」『』《》〈〉“”„«»‹›‘’‚"'])""")
_EVENT_TH = re.compile(r"""(?P<nl>\n)|(?P<term>[.!?。．！？…।॥｡]+)|(?P<mark>[()\[\]{}（）【】「」『』《》〈〉“”„«»‹›‘’‚"'])|(?P<gap>[ \xa0]+)""")
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n\s*")
_MARKER = re.compile(r"[ \t\xa0]*(?:(?P<num>\d{1,3})[.)](?=[ \t\xa0]|$)|\[\d{1,3}\](?=\s)|(?P<dash>[-–—])(?=[ \t\xa0])|[*•·‣◦>]+(?=[ \t\xa0])|#+(?=[\d ])|[\p{L}]{1,9}:(?=[ \t\xa0])|\(?\p{Ll}\)(?=[ \t\xa0])|<\p{L}+>)", re.M)
_SPEAKER = re.compile(r"(?:[QAFR]|Frage|Antwort|User|Assistant|Human|AI|System|问|答)[:：]")
_FENCE = re.compile(r"^[ \t]*```", re.M)
_THAI = re.compile(r"[฀-๿]")
# Words that carry a sentence on after a quotation or a pause, and verbs of speech.
_THAI_ON = ("และ", "แต่", "ดังนั้น", "เพราะ", "จึง", "หรือ", "ซึ่ง", "แล้ว", "ฯลฯ", "ๆ")
_ON = ("然后", "接着", "就", "并", "而", "又", "再", "と", "という", "って", "少し", "そして", "और", "फिर", "แล้ว", "ก่อน")
_SAID = frozenset("wondered asked said whispered replied answered wrote cried shouted added muttered noted thought called murmured".split())
_DATE_BEFORE = frozenset("am dem vom zum den der im ab bis seit".split())
_MONTH = re.compile(r"(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)")


class AbbreviationTrie:
    """Words, read from the end: class 1 never, 2 before numbers, 3 may end a sentence, 0 unknown."""

    def __init__(self, never: list[str], number: list[str], end: list[str]):
        self.root: dict = {}
        for kind, words in ((3, end), (2, number), (1, never)):
            for w in words:
                node = self.root
                for c in reversed(w.rstrip(".").lower()):
                    node = node.setdefault(c, {})
                node[""] = kind

    def kind(self, text: str, dot: int, low: int) -> tuple[int, int]:
        """Class of the longest abbreviation that ends at text[dot], starting no earlier than low, and its start."""
        node, i, best = self.root, dot - 1, (0, dot)
        while i >= low and (node := node.get(text[i].lower())) is not None:
            if "" in node and (i == low or not (text[i - 1].isalnum() or text[i - 1] in "-’'" or "ऀ" <= text[i - 1] <= "෿")):
                best = (node[""], i)
            i -= 1
        return best


_TRIE = AbbreviationTrie(NEVER, NUMBER, END)


def _cjk(c: str) -> bool:
    return "぀" <= c <= "ヿ" or "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"


def _caseless(c: str) -> bool:
    return c.isalpha() and not c.isupper() and not c.islower()


class _Paragraph:
    """One run of the automaton over text[low:high], which has no blank line."""

    def __init__(self, text: str, low: int, high: int, number: int, cased: bool):
        self.t, self.low, self.high, self.cased = text, low, high, cased
        self.number = number  # last list number, for the next paragraph
        self.units: list[tuple[int, int]] = []
        self.start = self.resume = low
        self.stack: list[tuple[str, int]] = []
        self.line = ""
        self.content = low
        self.apostrophe = -1
        self.found: dict[str, int] = {}  # next place of a mark, looked for once
        self.waiting: dict[str, int] = {}  # how often the stack waits for a mark

    def ahead(self, mark: str, p: int) -> int:
        """The next place of mark behind p; high if there is none."""
        if self.found.get(mark, -1) <= p:
            q = self.t.find(mark, p + 1, self.high)
            self.found[mark] = q if q >= 0 else self.high
        return self.found[mark]

    def skip(self, i: int) -> int:
        while i < self.high and self.t[i] in _SPACE:
            i += 1
        return i

    def cut(self, end: int, start: int) -> None:
        while end > self.start and self.t[end - 1] in _SPACE:
            end -= 1
        if end > self.start:
            if self.units and not self.t[self.start].isalnum() and not any(c.isalnum() for c in self.t[self.start : end]):
                self.units[-1] = (self.units[-1][0], end)
            else:
                self.units.append((self.start, end))
        self.start = self.resume = start
        self.stack.clear()
        self.waiting.clear()
        if start < self.high and (nl := self.t.rfind("\n", end, start)) >= 0:
            self.line = ""
            if (j := self.marker(nl + 1, False)) >= 0:
                self.resume = j

    def marker(self, i: int, open_unit: bool) -> int:
        """End of the list or speaker marker at line start i, or -1; keeps the list level."""
        m = _MARKER.match(self.t, i, self.high)
        if not m:
            return -1
        n = self.skip(m.end())
        if m["num"]:
            k = int(m["num"])
            if open_unit and k != self.number + 1 and not (k == 1 and self.number != 0):
                return -1
            if open_unit and self.number == 0 and k != 1:
                return -1
            if n < self.high and self.t[n].islower() and open_unit and self.cased:
                return -1
            self.number = k
        elif m["dash"]:
            if open_unit and n < self.high and self.t[n].islower() and self.line[:1] != m["dash"]:
                return -1
        elif m[0].rstrip().endswith((":", "：")) and not _SPEAKER.match(m[0].strip()):
            return -1
        self.line = m[0].strip()
        self.content = n
        return m.end()

    def run(self) -> list[tuple[int, int]]:
        t, high = self.t, self.high
        i = self.start = self.skip(self.low)
        if (j := self.marker(i, False)) >= 0:
            i = j
        event = (_EVENT_TH if not t.isascii() and _THAI.search(t, self.low, high) else _EVENT).search
        while i < high and (m := event(t, i, high)):
            a, i = m.span()
            kind = m.lastgroup
            if kind == "nl":
                i = self.newline(a)
            elif kind == "term":
                self.terminator(a, i)
            elif kind == "gap":
                if not self.stack and self.thai_gap(a, i):
                    self.cut(a, self.skip(i))
            else:
                self.mark(a)
            if self.resume > i:
                i = self.resume
        self.cut(high, high)
        return self.units

    def newline(self, a: int) -> int:
        n = self.skip(a + 1)
        if n >= self.high:
            return n
        first = self.t.rfind("\n", a, n) + 1
        line = self.line
        if self.start < a and (j := self.marker(first, True)) >= 0:
            self.cut(a, n)
            return self.resume
        if self.start >= a and (j := self.marker(first, False)) >= 0:
            self.start = n
            return j
        if line[:1] in (">", "#", "<") and self.start < a:
            self.line = ""
            self.cut(a, n)
        elif not self.stack and self.start < a and (_THAI.match(self.t, n) or _THAI.match(self.t, max(self.low, a - 1))) and self.thai_gap(a, n):
            self.cut(a, n)
        return n

    def thai_gap(self, a: int, b: int) -> bool:
        """Whether the space at a..b ends a Thai sentence."""
        t, n = self.t, self.skip(b)
        if n >= self.high or a <= max(self.start, self.content):
            return False
        p = a - 1
        before, c = t[p], t[n]
        s = p
        while s > self.start and t[s - 1] not in _SPACE:
            s -= 1
        e = n
        while e < self.high and t[e] not in _SPACE:
            e += 1
        chunk, after = t[s:a], t[n:e]
        if not (_THAI.search(chunk) or _THAI.search(after) or before == "%"):
            return False
        if after.startswith(_THAI_ON) or before in _TERM or c in "%(":
            return False
        if before != "%" and not _THAI.search(chunk) and before not in _CLOSERS:
            return False  # a number or a name that stands alone
        if "0" <= c <= "9":
            return False
        if c.isalpha() and not _THAI.match(c) and not _caseless(c):  # a name, unless a sentence of another script begins
            nn = self.skip(e)
            return c.isupper() and nn < self.high and not _THAI.match(t, nn) and (t[nn].isalpha() or t[nn] in "\"“«")
        if len(after) <= 10:  # names of things in a list, joined by a word for "and"
            nn = self.skip(e)
            if t.startswith("และ", nn) or t.startswith("หรือ", nn):
                return False
        return True

    def terminator(self, a: int, b: int) -> None:
        if self.stack:
            return
        t, c = self.t, b
        while c < self.high and t[c] in _CLOSERS and not (t[c] in "\"'" and (self._opens(c) or c + 1 < self.high and t[c + 1].isalnum() and self.ahead(t[c], c) < self.high)):
            c += 1
        if "»" in t[b:c] and self._opens(t.index("»", b)):
            c = b
        n = self.skip(c)
        if n >= self.high or not self.ends(a, b, c, n):
            return
        self.cut(c, n)

    def ends(self, a: int, b: int, c: int, n: int) -> bool:
        t, mark, x, spaced = self.t, self.t[a:b], self.t[n], n > c
        prev = t[a - 1] if a > self.low else " "
        low = x.islower() and self.cased
        if mark.strip("….") == "":
            if len(mark) > 1 or mark == "…":
                if low or x in ",;:":
                    return False
                if _cjk(x) or _cjk(prev):
                    return a - self.start > 4 and not t.startswith(_ON, n)
                return spaced or x.isupper()
            return self.full_stop(a, c, n, x, spaced, prev)
        if any(m in _WIDE for m in mark) or "।" in mark or "॥" in mark:
            return x not in "，,；;、"
        if not spaced:
            return x.isupper() and prev.isalnum() or _cjk(x) and (_cjk(prev) or c > b) or x in "“«¿¡„「《" or _THAI.match(x) is not None and _THAI.match(prev) is not None
        return not low and x not in ",;:—–" or x in "—–" and "\n" in t[c:n]

    def full_stop(self, a: int, c: int, n: int, x: str, spaced: bool, prev: str) -> bool:
        t = self.t
        capital = x.isupper() or _caseless(x) or x in "“«„\"'‘»¿¡([#<>*•-—–（「《【" or not self.cased and x.islower()
        kind, at = _TRIE.kind(t, a, self.start)
        if not spaced:
            if _cjk(x) and _cjk(prev):
                return True
            if _caseless(x) and prev.isalnum() and not _caseless(prev) and not kind and self.t.count(" ", self.start, a) > 2:
                return True  # a sentence of another script follows without a space
            if not x.isupper() or kind in (1, 2) or prev.isupper() or not (prev.isalnum() or prev in _CLOSERS):
                return x in "“«¿„\"" and prev.isalpha() and kind not in (1, 2)
            if kind == 3 and "." in t[at:a] or not kind and t[max(self.start, a - 4) : a].isalpha() and t[max(self.start, a - 4) : a].islower():
                return True
            return n + 1 >= self.high or t[n + 1].islower() or t[n + 1] in _SPACE or _caseless(x)
        if t[a - 1 : a].isdigit():
            s = a
            while s > self.start and (t[s - 1].isdigit() or t[s - 1] in ".,:"):
                s -= 1
            if x.islower() and self.cased:
                return False
            if x.isdigit() or x.isupper():
                short = a - s <= 2
                if short and (x.isdigit() or _MONTH.match(t, n)):
                    return not (x.isupper() or self._word_before(s) in _DATE_BEFORE or self._after_digit(n))
                return not (short and self._word_before(s) in _DATE_BEFORE)
            return True
        if kind == 1:
            return False
        if kind == 2 and x.isdigit():
            return False
        if kind:
            return capital or x.isdigit() and t[at:a].lower() in ("etc", "usw", "p.m", "a.m", "ฯลฯ")
        if prev.isalpha() and (a - 2 < self.start or not (t[a - 2].isalnum() or "ऀ" <= t[a - 2] <= "ൿ")):
            if prev.isupper() and not _cjk(prev):  # an initial
                return not (x.isupper() or x.islower()) and capital
            if prev.islower() and self.cased:
                return capital and self._word_before(a - 1) in ("т.", "т", "и", "і") or capital and len(self._word_before(a - 1)) == 0
        if x.islower() and self.cased:
            return False
        return x not in ",;:"

    def _word_before(self, i: int) -> str:
        e = i
        while e > self.start and self.t[e - 1] in _SPACE:
            e -= 1
        s = e
        while s > self.start and self.t[s - 1] not in _SPACE:
            s -= 1
        return self.t[s:e].lower()

    def _after_digit(self, n: int) -> bool:
        """A date like 15. 8. follows."""
        return re.match(r"\d{1,2}\.(?:\s|$)", self.t[n : n + 4]) is not None

    def _opens(self, i: int) -> bool:
        """Whether a quote that may open or close opens here: white space before, none after."""
        return (i <= self.low or self.t[i - 1] in _SPACE or self.t[i - 1] in "([（:：") and i + 1 < self.high and self.t[i + 1] not in _SPACE

    def mark(self, p: int) -> None:
        t, c = self.t, self.t[p]
        if self.stack and c in self.stack[-1][0]:
            self.close(p)
            return
        if self.waiting.get(c, 0) and c not in "\"'«»“":
            while c not in self.stack[-1][0]:
                self.pop()
            self.close(p)
            return
        if c == "'" or c == "’":
            if c == "’" or not self._opens(p):
                return
            if self.apostrophe <= p:  # the next one that can close, looked for once
                q = t.find("'", p + 1, self.high)
                while q > 0 and q + 1 < self.high and t[q + 1].isalnum():
                    q = t.find("'", q + 1, self.high)
                self.apostrophe = q if q > 0 else self.high
            if self.apostrophe >= self.high:
                return
        elif c == "»" and not self._opens(p):
            return
        elif c == '"' and self.ahead('"', p) >= self.high:
            return
        closing = _PAIRS.get(c)
        if closing is None or all(self.ahead(x, p) >= self.high for x in closing):
            return
        self.stack.append((closing, p))
        for x in closing:
            self.waiting[x] = self.waiting.get(x, 0) + 1

    def pop(self) -> int:
        closing, at = self.stack.pop()
        for x in closing:
            self.waiting[x] -= 1
        return at

    def close(self, p: int) -> None:
        at = self.pop()
        if self.stack:
            return
        t, c = self.t, p + 1
        inner = p - 1
        while inner > at and t[inner] in _SPACE:
            inner -= 1
        if t[inner] not in _TERM:
            return
        while c < self.high and t[c] in _CLOSERS and t[c] not in "\"'":
            c += 1
        n = self.skip(c)
        if n >= self.high:
            return
        x = t[n]
        if x in ",;:，；：、—–.。!?！？…" and "\n" not in t[c:n]:
            return
        first = self.start if (m := _MARKER.match(t, self.start, self.high)) is None else self.skip(m.end())
        leads = at <= first
        if t[at] in _BRACKETS:
            if leads and not (x.islower() and self.cased):
                self.cut(c, n)
            return
        if x.islower():
            return
        b = at - 1
        while b > self.low and t[b] in _SPACE:
            b -= 1
        if _caseless(x):
            says = b >= self.low and t[b] in ":："
            if t.startswith(_ON, n) or leads and not says or not (says or n > c or _cjk(x)):
                return
            self.cut(c, n)
            return
        if x.isupper() and leads:
            words = t[n : n + 60].split(None, 2)
            if len(words) > 1 and words[1].strip(".,!?…").lower() in _SAID or len(words) > 1 and re.match(r"[ऀ-ॿ]", words[1]):
                return
            if len(words) > 1 and _cjk(words[0][-1]):
                return
            if re.match(r"[\p{Lu}][\p{Ll}]+[぀-ヿ㐀-鿿]", t, pos=n) or re.match(r"\p{L}+ ?[぀-ヿ㐀-鿿]", t[n : n + 30]):
                return
        elif x.isupper() and (_cjk(t[b]) or _cjk(t[inner - 1])) and re.match(r"[A-Za-z]+[㐀-鿿]", t[n : n + 30]) and t[b] not in ":：":
            return
        self.cut(c, n)


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Start and end of every sentence unit of a text, in order. Null and blank texts have none."""
    if not text:
        return []
    cased = text != text.lower()
    out: list[tuple[int, int]] = []
    number = 0
    for low, high, code in _blocks(text):
        if code:
            s, e = low, high
            while s < e and text[s] in _SPACE:
                s += 1
            while e > s and text[e - 1] in _SPACE:
                e -= 1
            if e > s:
                out.append((s, e))
            continue
        p = _Paragraph(text, low, high, number, cased)
        out += p.run()
        number = p.number
    return out


def _blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Paragraphs, and fenced code as a whole."""
    fences = [m.start() for m in _FENCE.finditer(text)] if "```" in text else []
    parts, at = [], 0
    for k in range(0, len(fences), 2):
        parts.append((at, fences[k], False))
        end = len(text)
        if k + 1 < len(fences):
            nl = text.find("\n", fences[k + 1])
            end = len(text) if nl < 0 else nl
        parts.append((fences[k], end, True))
        at = end
    parts.append((at, len(text), False))
    for low, high, code in parts:
        if code:
            yield low, high, True
            continue
        for m in _PARAGRAPH.finditer(text, low, high):
            yield low, m.start(), False
            low = m.end()
        yield low, high, False
