"""Sentence units across languages and scripts.

Blank lines part paragraphs. Within one, every place where a sentence might end is a node of a lattice; the marks before
it, the words on both sides, open quotations and brackets, and the boundary before it give the cost of ending there, and
the cheapest path through the paragraph is taken. Scripts that put blanks between words have nodes after terminators
(with their closing quotes). Scripts without such blanks are parted into words by the cheapest path through a lattice of
dictionary words, over whole stretches of letters; besides terminators, their gaps at blanks, at wrapped lines and
between a final and an opening word are nodes, classified by the final particle before and the opening word after.
"""

from __future__ import annotations

import base64
import math
import os
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK_LINES = re.compile(r"(?:\r\n|[\n\r\x0b\x0c\x85  ])(?:[^\S\r\n\x85  ]*(?:\r\n|[\n\r\x85  ]))+| ")
#: Sentences after which a batch is handed over.
FLUSH = 500_000
TERMINATORS = ".!?…。．！？｡؟۔।॥‼⁇⁈⁉"
WIDE = frozenset("。！？｡؟۔।॥‼⁇⁈⁉．")
CLUSTER = re.compile(f"[{re.escape(TERMINATORS)}]+")
# Quotation marks and brackets, opening and closing.
OPENS = {"“": "”“", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "〈": "〉", "‘": "’", "‚": "‘’", '"': '"', "`": "`"}
_MARKS = frozenset(OPENS) | frozenset("".join(OPENS.values()))
QUOTES = frozenset("“„«‹「『\"`‘‚")
# Short forms that never end a sentence, by the text before their last full stop, in lower case.
NEVER = frozenset(
    """dr prof mr mrs ms messrs st rev gen col capt sen rep hon fig figs eq eqs ref refs sec ch vol no nos nr pp p ed eds cf e.g i.e viz vs v approx ca c al
    dept univ est min max resp incl excl suppl supp var subsp ssp sp spp cv str tab tabs abb abbn bd hrsg vgl bzw z z.b d d.h u u.a o s.o u.u.u zzgl inkl evtl ggf sog bspw
    env art mme mlle mm ex p.ex pl aprox sr sra srta dra ej p.ej pág págs ee núm lic ing ud uds см рис табл ок т т.е т.к т.н г гг ул стр напр им проф акад д
    डॉ श्री श्रीमती प्रो मि मि.ग्रा ग्रा कि.मी कि सं पृ د أ م ص ج ดร ศ รศ ผศ พ.ศ น.ส น ถ""".split()
)
# Short forms that may end a sentence, when a capital follows.
MAYBE = frozenset("etc usw u.s u.k u.n e.u u.s.a a.m p.m b.c a.d ph.d m.d inc ltd co corp jr et.al т.д т.п др пр ee.uu uu ff".split())
LIST_ITEM = re.compile(r"(?:[0-9]{1,3}|[a-zA-Z]|[ivxIVX]{1,4})[.)]\s|[•*–-]\s")
# Names of months, which an ordinal with a full stop may precede.
MONTHS = re.compile(r"(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jan|Feb|Apr|Jun|Jul|Aug|Sep|Sept|Okt|Nov|Dez|januar|april)\b")
# Words of saying, which follow a quotation that begins a sentence.
SAYING = re.compile(
    r"\b(?:ask|said|say|wrot|write|repl|remark|note|insist|wonder|answer|fragt|sagt|schrieb|meint|antwort|demand|écri|répond|dit\b|pregunt|dijo|escrib|respond|спрос|сказал|написал|ответил|заметил)"
    r"|问|说|写道|答道|回答|表示|पूछा|कहा|लिखा|बोल|जवाब|سأل|قال|كتب|أجاب|ถาม|กล่าว|ตอบ"
)
# Words with which a sentence goes on after a quotation or an ellipsis, in scripts without blanks.
GOES_ON = frozenset("と って との という といった とか か を が は も に で の から まで など へ だ です 后来 然后 随后 接着 之后 就 便 并 而 这句话 这番话 这段话 这个 的 是 了 そして でも 但 但是 却 又 还".split())
# Particles and forms that end a sentence, in Japanese, Chinese and Thai; the first group hardly ever stands within one.
STRONG_FINALS = frozenset(
    """です ます でした ました ません ですね ますね ですよ ますよ ですか ますか でしょう でしょうか だろう である だった ください なさい ましょう ましたか
    吗 呢 吧 啊 呀 嘛 啦 哦 ครับ ค่ะ คะ จ้ะ จ้า นะคะ นะครับ นะ""".split()
)
WEAK_FINALS = frozenset("だ た ない か ね よ わ ぞ さ かな のに 了 过 着 来 去 แล้ว เลย ด้วย จริง".split())
# Words that open a sentence.
OPENINGS = frozenset(
    """そして しかし また ただし つまり なお だから それ それで これ この その あの 私 彼 彼女 次に まず さらに しかも ところが ところで では 一方 例えば もし 今日 明日 昨日
    我 我们 你 你们 他 她 它 他们 她们 这 那 这些 那些 但是 但 因此 所以 然而 不过 此外 另外 首先 其次 最后 如果 虽然 由于 因为 后来 然后 接着 随后 同时 而且 于是 今天 明天 昨天 请
    แต่ ดังนั้น เพราะ เมื่อ หลังจาก ผม ฉัน ดิฉัน เขา เธอ เรา นอกจากนี้ อย่างไรก็ตาม ถ้า หาก วันนี้ พรุ่งนี้ เมื่อวาน ขอ""".split()
)
_POLITE = tuple(f for f in STRONG_FINALS if len(f) > 1 and "\u3040" <= f[0] <= "\u309f")
_CORE = GOES_ON | STRONG_FINALS | WEAK_FINALS | OPENINGS
#: A final and an opening side by side: where a gap without any mark may end a sentence.
_UNMARKED = re.compile("(?:" + "|".join(sorted(STRONG_FINALS, key=len, reverse=True)) + ")(?=(?:" + "|".join(sorted(OPENINGS, key=len, reverse=True)) + "))")
_LETTER = "[\u3005\u3006\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e00-\u0e7f\U00020000-\U0003ffff]"
#: Letters of scripts without blanks; a single line break within them is only a wrapped line.
STRETCH = re.compile(f"{_LETTER}+(?:[^\\S\\n]*\\n[^\\S\\n]*{_LETTER}+)*")
_DENSE_BLANK = re.compile(f"(?<={_LETTER})\\s+(?={_LETTER})")
_HAS_DENSE = re.compile(_LETTER).search
_CLUSTER_TH = re.compile("[เ-ไ]?[ก-ฮ][ะ-ฺ็-๎ๅ]*|.", re.DOTALL)


def _spaceless(ch: str) -> bool:
    return "぀" <= ch <= "ヿ" or "㐀" <= ch <= "鿿" or "豈" <= ch <= "﫿" or "฀" <= ch <= "๿" or "\U00020000" <= ch <= "\U0003ffff"


def _thai(ch: str) -> bool:
    return "ก" <= ch <= "๎" and ch != "฿" or ch in "๏๚๛"


class Lattice:
    """A lattice of dictionary words over a stretch without blanks; the cheapest path parts it into words.

    A word costs the bits of its rank in a public vocabulary, a function word of the lists above less, an unknown letter
    (in Thai: letter with its vowels and tone marks) more than any word.
    """

    FUNCTION, UNKNOWN = 6.0, 18.0

    def __init__(self, ranks: dict[str, int] | None = None):
        self.cost = {w: math.log2(r + 2) for w, r in (ranks or {}).items()} | {w: self.FUNCTION + 1 / len(w) for w in _CORE}
        self.longest = max(map(len, self.cost))

    @classmethod
    def read(cls, path: str) -> Lattice:
        """The words of a rank file (a token in base64 and its rank) that are written in Han, kana or both; only the function words if there is no such file.

        Thai tokens of byte-pair vocabularies are parts of syllables and are left out.
        """
        ranks: dict[str, int] = {}
        if os.path.exists(path):
            with open(path, "rb") as f:
                for line in f:
                    token, rank = line.split()
                    word = base64.b64decode(token).decode("utf-8", "replace").strip()
                    if word and all(_spaceless(c) and not "\u0e00" <= c <= "\u0e7f" for c in word) and word not in ranks:
                        ranks[word] = int(rank)
        return cls(ranks)

    def ends(self, text: str) -> list[int]:
        """Where the words of the cheapest path end; of equally cheap paths the one with longer words first."""
        n = len(text)
        if "\u0e00" <= text[:1] <= "\u0e7f":
            unknown = {m.start(): m.end() for m in _CLUSTER_TH.finditer(text)}
        else:
            unknown = None
        best = [math.inf] * (n + 1)
        back = [0] * (n + 1)
        best[0] = 0.0
        cost, longest = self.cost, self.longest
        for i in range(n):
            here = best[i]
            if here == math.inf:
                continue
            j = i + 1 if unknown is None else unknown.get(i, i + 1)
            if here + self.UNKNOWN < best[j]:
                best[j], back[j] = here + self.UNKNOWN, i
            for j in range(i + 1, min(n, i + longest) + 1):
                c = cost.get(text[i:j])
                if c is not None and here + c < best[j]:
                    best[j], back[j] = here + c, i
        out, j = [], n
        while j:
            out.append(j)
            j = back[j]
        return out[::-1]


CORE = Lattice()


def spans_of(text: str) -> list[tuple[int, int, str]]:
    """Matched quotations and brackets (start, end, opening mark), outermost first; marks without a partner are ignored."""
    stack: list[tuple[int, str]] = []
    waiting: Counter = Counter()  # closing marks that some open mark waits for, so that the stack is searched only where it holds one
    out: list[tuple[int, int, str]] = []
    for i, ch in enumerate(text):
        if ch not in _MARKS or (ch in "’‘" and 0 < i < len(text) - 1 and text[i - 1].isalnum() and text[i + 1].isalnum()):
            continue  # no mark, or an apostrophe
        at = None
        if waiting[ch]:
            at = next(k for k in range(len(stack) - 1, -1, -1) if ch in OPENS[stack[k][1]])
            if ch == "“" == stack[at][1]:
                at = None  # opens anew
        if at is not None:
            out.append((stack[at][0], i, stack[at][1]))
            for _, mark in stack[at:]:
                waiting.subtract(OPENS[mark])
            del stack[at:]
        elif ch in OPENS:
            stack.append((i, ch))
            waiting.update(OPENS[ch])
    return sorted(out)


@dataclass
class Node:
    """A place where a sentence may end: the end of its marks, where the next one would start, and the cost of ending.

    ``quote`` is the start of a quotation that closes here; ``marked`` tells whether there are marks at all.
    """

    end: int
    start: int
    cost: float
    quote: int | None = None
    marked: bool = True


def _token_before(text: str, i: int) -> tuple[str, int]:
    """The text without blanks, quotes and brackets before position i, and where it begins."""
    j = i
    while j and not text[j - 1].isspace() and text[j - 1] not in "([{（「『“„«\"‘" and not (_spaceless(text[j - 1]) and not _spaceless(text[i - 1])):
        j -= 1
    return text[j:i], j


def _cased(ch: str) -> bool:
    return ch.lower() != ch.upper()


class Paragraph:
    """One paragraph: its spans, its nodes, and the sentences on the cheapest path."""

    def __init__(self, text: str, lattice: Lattice = CORE):
        self.text = text
        self.lattice = lattice
        self.spans = spans_of(text)
        self.closing = {e: (s, mark) for s, e, mark in self.spans}
        depth = np.zeros(len(text) + 1, dtype=np.int32)
        for s, e, _ in self.spans:
            depth[s + 1] += 1
            depth[e] -= 1  # the closing mark itself is outside
        self.depth = np.cumsum(depth) if self.spans else None
        self.stretches: list[tuple[int, int]] | None = None
        self.known: dict[int, tuple[dict[int, str], dict[int, str]]] = {}

    def inside(self, i: int) -> bool:
        """Whether the character at i lies within a quotation or bracket that is closed later."""
        return self.depth is not None and i < len(self.text) and bool(self.depth[i] > 0)

    def words(self, at: int) -> tuple[dict[int, str], dict[int, str]]:
        """The words of the stretch that holds a place, by where they end and by where they start. The whole stretch is parted, once."""
        if self.stretches is None:
            self.stretches = [m.span() for m in STRETCH.finditer(self.text)]
        k = bisect_right(self.stretches, (at, len(self.text) + 1)) - 1
        if k < 0 or not self.stretches[k][0] <= at <= self.stretches[k][1]:
            return {}, {}
        if k not in self.known:
            a, b = self.stretches[k]
            places = [i for i in range(a, b) if not self.text[i].isspace()]
            whole = "".join(self.text[i] for i in places)
            ending, starting, begin = {}, {}, 0
            for end in self.lattice.ends(whole):
                word = whole[begin:end]
                starting[places[begin]] = ending[places[end - 1] + 1] = word
                begin = end
            self.known[k] = ending, starting
        return self.known[k]

    def first_word(self, at: int) -> str:
        return self.words(at)[1].get(at, "")

    def nodes(self) -> list[Node]:
        text, out = self.text, []
        for m in CLUSTER.finditer(text):
            end = m.end()
            quote = None  # start of an outermost quotation closed here
            while end < len(text):
                skip = end + 1 if text[end].isspace() and end + 1 < len(text) and text[end + 1] in "»›" and end + 1 in self.closing else end
                if skip in self.closing and self.closing[skip][0] < m.start():
                    if self.closing[skip][1] in QUOTES:
                        quote = self.closing[skip][0]
                    end = skip + 1
                    continue
                break
            nxt = end
            while nxt < len(text) and text[nxt].isspace():
                nxt += 1
            if nxt >= len(text):
                break
            cost = self.cost(m[0], m.start(), end, nxt, quote)
            if cost is not None:
                out.append(Node(end, nxt, cost, quote))
        if _HAS_DENSE(text):
            known = {n.start for n in out}
            more = [m.span() for m in _DENSE_BLANK.finditer(text)] + [(m.end(), m.end()) for m in _UNMARKED.finditer(text)]
            for a, b in more:
                if b not in known:
                    known.add(b)
                    if (cost := self.unmarked(a, b)) is not None:
                        out.append(Node(a, b, cost, None, False))
            out.sort(key=lambda n: (n.end, n.start))
        return out

    def unmarked(self, a: int, b: int) -> float | None:
        """The cost of ending at a gap between letters of a script without blanks, by the final particle before it and the opening word after it.

        In Thai a blank ends a sentence, and words only make it surer. Elsewhere a blank needs a final, a wrapped line
        or no blank at all a sure final and an opening. A word of the lattice that spans the gap leaves none.
        """
        if self.inside(b):
            return 4.0
        before, after = self.words(a)[0].get(a), self.words(b)[1].get(b)
        final = 7.0 if _strong(before) else 3.0 if before in WEAK_FINALS else 0.0
        opening = 4.0 if after in OPENINGS else 0.0
        if a < b and _thai(self.text[a - 1]) and _thai(self.text[b]):
            return -2.0 - (final > 0) - (opening > 0)
        if before is None or after is None:
            return None
        gap = 10.0 if a == b else 8.0 if "\n" in self.text[a:b] else 4.0
        return gap - final - opening

    def cost(self, marks: str, at: int, end: int, nxt: int, quote: int | None) -> float | None:
        """Below zero: a sentence ends here. None: no node at all."""
        text = self.text
        ch, gap = text[nxt], nxt > end
        wide = any(c in WIDE for c in marks)
        ellipsis = not wide and marks.strip(".…") == "" and (len(marks) > 1 or marks == "…")
        if marks == "．" and at and text[at - 1].isdigit() and text[at + 1 : at + 2].isdigit():
            return None
        if not gap and not wide and not self.run_together(marks, at, end, ellipsis):
            return 6.0 if ellipsis else None
        if self.inside(nxt) or (self.inside(end) and end < len(text)):
            return 5.0
        if quote is not None:
            return self.after_quote(nxt, quote, False)
        if ch in ",;:，、；：)]}）」』»…" or (ch in "—–" and not ellipsis and not wide):
            return 4.0
        lower = _cased(ch) and ch == ch.lower()
        if ellipsis:
            if lower or not _cased(ch):
                first = self.first_word(nxt) if _spaceless(ch) else ""
                return 5.0 if lower or first in GOES_ON else 2.0
            return -1.0 if text[nxt + 1 : nxt + 2].islower() else 2.0
        if wide:
            return -5.0
        if marks != ".":  # ! and ?
            return -1.0 if lower else -4.0
        return self.full_stop(at, nxt, ch, lower)

    def run_together(self, marks: str, at: int, end: int, ellipsis: bool) -> bool:
        """Whether marks without a blank after them may still end a sentence: a capital or an opening mark follows, and before a full stop there is a whole word or number."""
        text = self.text
        ch = text[end]
        opens = ch in "¿¡“„«「" or (_cased(ch) and ch == ch.upper())
        if marks != "." or end > at + 1:
            return not ellipsis and (opens or _spaceless(ch))
        token, _ = _token_before(text, at)
        return opens and text[end + 1 : end + 2] != "." and bool(re.search(r"[^\W_]{2}$|[^\w.]$|[0-9]$", token)) and not re.search(r"[/@]|\.[^\W\d]", token)

    def full_stop(self, at: int, nxt: int, ch: str, lower: bool) -> float:
        token, begin = _token_before(self.text, at)
        word = token.lower()
        if LIST_ITEM.match(self.text, nxt) and "\n" in self.text[at:nxt]:
            return -6.0
        if re.fullmatch(r"[0-9]{1,3}|[a-zA-Z]|[ivxIVX]{1,4}", token):
            k = begin
            while k and self.text[k - 1].isspace():
                k -= 1
            if not k or (self.text[k - 1] in TERMINATORS + ":;”\"»“)" and "\n" in self.text[k:begin]):
                return 6.0  # a list number; in a wrapped line, the line before doesn't end so
        if token.isdigit() and len(token) < 3 and MONTHS.match(self.text, nxt):
            return 5.0
        if word in NEVER:
            return -1.0 if word == "no" and _cased(ch) and not lower else 5.0
        if word in MAYBE:
            return -1.0 if not _cased(ch) or ch == ch.upper() else 2.0
        if len(token) == 1 and token.isalpha() and token == token.upper() and _cased(token):
            return 3.0  # an initial
        if re.fullmatch(r"(?:\w\.)+\w", word) and not word.replace(".", "").isdigit():
            return 2.0  # letters with full stops between
        if lower:  # a name that is written small may begin a sentence, but not after what may be a short form
            unit = len(token) < 3 and self.text[max(0, begin - 2) : begin - 1].isdigit()
            return -1.0 if unit or len(token) > 1 else 3.0
        return -4.0

    def after_quote(self, nxt: int, quote: int, begins: bool) -> float:
        """A quotation that closes with a terminator: the sentence goes on after it, or ends with it. ``begins``: the quotation begins the sentence."""
        text, ch = self.text, self.text[nxt]
        spaceless = any(map(_spaceless, text[quote:nxt])) and not text[nxt - 1].isspace()
        if ch in ",;:，、；：—–-)]）" or (_cased(ch) and ch == ch.lower() and not spaceless):
            return 4.0
        if _spaceless(ch):
            if self.first_word(nxt) in GOES_ON:
                return 4.0
            led = not begins and text[:quote][-80:].rstrip().endswith(("：", ":", "、", "，"))
            if "぀" <= ch <= "ゟ" and text[nxt - 1] in "」』" and not led:
                return 2.0
        if begins:
            stop = next((m.start() for m in CLUSTER.finditer(text, nxt, nxt + 100) if m[0] != "." or m.end() == len(text) or (text[m.end()].isspace() and _token_before(text, m.start())[0].lower() not in NEVER)), min(len(text), nxt + 100))
            clause = text[nxt:stop]
            if len(clause) <= 80 and SAYING.search(clause.lower()) and not any(c in clause for c in "“„«「"):
                return 3.0
        return -4.0 if ch in QUOTES else -3.0  # a quotation right after another begins a sentence

    def sentences(self) -> list[tuple[int, int]]:
        """The cheapest path through the nodes, where the cost of ending at one depends on the boundary before it.

        Without a letter or digit since that boundary ending is dear, at a gap without marks also with fewer than four;
        a quotation that begins the sentence may be followed by who said it. Boundaries are kept by the number of
        letters before them, so that only those close by are looked at one by one, and the rest by their least cost.
        """
        nodes, text = self.nodes(), self.text
        if not nodes:
            return _trimmed(text, [(0, len(text))])
        count = np.concatenate([[0], np.cumsum(np.fromiter(map(str.isalnum, text), dtype=np.int64, count=len(text)))])
        best: list[tuple[float, int]] = []  # cost of the path that ends at a node, and the node before
        far: list[tuple[float, int]] = [(0.0, -1)]  # the two cheapest boundaries far back; -1 is the start of the paragraph
        near: deque[tuple[int, list[tuple[float, int]]]] = deque()  # by letters before them
        starts = {0: -1}
        for i, n in enumerate(nodes):
            here = int(count[n.end])
            while near and near[0][0] <= here - 4:
                far = _two(far, near.popleft()[1])
            begins = starts.get(n.quote) if n.quote is not None else None
            options = []
            for a, group in [(-1, far), *near]:
                for cost, j in group:
                    letters = here if j < 0 else here - int(count[nodes[j].start])
                    own = self.after_quote(n.start, n.quote, True) if begins is not None and j == begins else n.cost
                    options.append((cost + own + (8 if letters == 0 else 6 if letters < 4 and not n.marked else 0), j))
            best.append(min(options))
            starts[n.start] = i
            a = int(count[n.start])
            if near and near[-1][0] == a:
                near[-1] = a, _two(near[-1][1], [(best[i][0], i)])
            else:
                near.append((a, [(best[i][0], i)]))
        for _, group in near:
            far = _two(far, group)
        at, chosen = far[0][1], []
        while at >= 0:
            chosen.append(at)
            at = best[at][1]
        out, start = [], 0
        for k in reversed(chosen):
            out.append((start, nodes[k].end))
            start = nodes[k].start
        out.append((start, len(text)))
        return _trimmed(text, out)


def _strong(word: str | None) -> bool:
    """A sure final, or a verb in a polite form, which ends with one of two letters or more."""
    return word is not None and (word in STRONG_FINALS or any(word.endswith(f) for f in _POLITE))


def _two(a: list[tuple[float, int]], b: list[tuple[float, int]]) -> list[tuple[float, int]]:
    return sorted(a + b, key=lambda x: (x[0], -x[1]))[:2]


def _trimmed(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in ((a + len(text[a:b]) - len(text[a:b].lstrip()), a + len(text[a:b].rstrip())) for a, b in spans) if a < b]


def sentence_spans(text: str | None, lattice: Lattice = CORE) -> list[tuple[int, int]]:
    """Start and end of each sentence in code points, without white space around it; none for null, empty and blank texts."""
    if text is None or not text.strip():
        return []
    out: list[tuple[int, int]] = []
    at = 0
    cuts = [(m.start(), m.end()) for m in BLANK_LINES.finditer(text)] + [(len(text), len(text))]
    for a, b in cuts:
        part = text[at:a]
        lead = len(part) - len(part.lstrip())
        if body := part.strip():
            out += [(at + lead + s, at + lead + e) for s, e in Paragraph(body, lattice).sentences()]
        at = b
    return out


def split_sentences(documents: DataFrame, key: str, text: str, vocabulary: str = "") -> DataFrame:
    """``key BIGINT, sent_start BIGINT, sent_end BIGINT``: each sentence of each document's whole text.

    ``vocabulary`` is the path of a public rank file whose words make the lattice of scripts without blanks (a few
    thousand words, read on the driver and sent along); without it the lattice knows function words only. Rows stay
    where they are: no shuffle. Repeated rows give repeated sentences, null, empty and blank texts none, an empty table
    an empty one. A text of any length is read once, paragraph by paragraph.
    """
    lattice = Lattice.read(vocabulary) if vocabulary else CORE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, ends = [], [], []
            for i, (k, t) in enumerate(zip(batch.column(0), batch.column(1))):
                found = sentence_spans(t.as_py(), lattice)
                keys += [k.as_py()] * len(found)
                starts += [a for a, _ in found]
                ends += [b for _, b in found]
                if len(keys) > FLUSH or i + 1 == len(batch):  # long texts leave in several batches
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "sent_start", "sent_end"])
                    keys, starts, ends = [], [], []

    return documents.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").cast("string").alias("t")).mapInArrow(run, "doc_id bigint, sent_start bigint, sent_end bigint")
