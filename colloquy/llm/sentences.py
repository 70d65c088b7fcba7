"""Problem 9: sentence units of documents in any script.

Character properties decide what ends a sentence (the Sentence_Break classes STerm, ATerm, Close), tailored by what follows, by
abbreviations of the language that is spoken just there, and by quotations and brackets, whose stops don't end the sentence around
them. Headings, list items and fenced blocks are units of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Abbreviations by language, without the final stop, in lower case.
#: Before a name, written with a capital: never the end of a sentence.
TITLES = {
    "en": "mr mrs ms dr prof st rep gen col capt lt sgt rev hon messrs jr sr mt ft",
    "de": "hr fr dr prof dipl ing st hl",
    "es": "sr sra srta sres dr dra prof lic ing d dña ud uds",
    "fr": "m mm mme mmes mlle mlles dr pr me st ste",
    "hi": "डॉ श्री प्रो सु कु पं",
    "ar": "د أ م",
}
#: Before an example or an explanation: never the end of a sentence.
LEADS = {
    "en": "approx vs viz cf cp e.g i.e eg ie eds",
    "de": "ca bzw vgl z.b d.h u.a o.ä evtl inkl exkl sog",
    "es": "aprox ej p.ej ee",
    "fr": "env cf ex p.ex éd",
}
#: Before a number: a sentence ends after it only where something else begins one.
NUMBERED = {
    "en": "fig figs sec secs ch nos vol pp p eq eqs ref refs",
    "de": "nr abb kap bd tel",
    "es": "núm nro pág págs fig vol tel",
    "fr": "p pp n fig chap vol tél",
}
#: Words in their own right too: abbreviations only before a number.
WORDS = {
    "en": "no app tab art cap ed est",
    "de": "art abs str tab s",
    "es": "no art cap av est",
    "fr": "art av bd est",
}
#: May close a sentence too: then something that begins a sentence follows.
EITHER = {
    "en": "etc a.m p.m u.s u.k u.n min mins hr hrs inc ltd co corp al jan feb mar apr jun jul aug sep sept oct nov dec mon tue wed thu fri sat sun max",
    "de": "usw usf min std etc mio mrd jh jhd",
    "es": "etc uu min máx hs a.m p.m",
    "fr": "etc min max",
}
#: After a day's number and a stop: the date goes on.
MONTHS = {"de": "januar jänner februar märz april mai juni juli august september oktober november dezember"}
#: Words by which a language is known, many of which begin sentences.
FUNCTION = {
    "en": "the of and to in is was are that for with as at by on this it from be not but were has had which they you we he she his her their or an before after then there if when what how why so our i my your its these those one all no yes",
    "de": "der die das und ist nicht mit den dem des ein eine einen zu von auf für im in wurde sich auch wird sind nach bei hat als war wie wurden noch nur es er sie wir ich dann dort wenn was warum so kein keine",
    "es": "el la los las de que y en un una es no se por con para del al lo su como más fue está pero han sus ya si cuando qué esto este esta entonces nadie según",
    "fr": "le la les des et est un une que qui dans pour pas sur au aux du de ne ce cette il elle sont par avec été mais plus ils elles nous je on si quand puis alors cela selon",
}
_flat = lambda d: frozenset(w for x in d.values() for w in x.split())
_by_word = lambda d: {w: frozenset(k for k, x in d.items() if w in x.split()) for w in _flat(d)}
_KINDS = {"title": _by_word(TITLES), "lead": _by_word(LEADS), "numbered": _by_word(NUMBERED), "word": _by_word(WORDS), "either": _by_word(EITHER)}
_ABBREVIATED = frozenset(w for k in _KINDS.values() for w in k)
_FUNCTION, _MONTHS, _ALL = _by_word(FUNCTION), _flat(MONTHS), frozenset(TITLES) | frozenset(FUNCTION)

_SPACE = r"[\s​﻿]"
_FENCE = regex.compile(r"[ \t]*(`{3,}|~{3,})")
_HEAD = regex.compile(r"[ \t]{0,3}#{1,6}(?:[ \t]|$)")
_ITEM = regex.compile(r"[ \t]*(?:[-*+•‣◦]|\d{1,3}[.)])[ \t]+\S")
_NUMBERED = regex.compile(r"[ \t]*\d")
_BLANK = regex.compile(rf"{_SPACE}*$")
_LEFT = regex.compile(rf"{_SPACE}*")

_OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}
_EITHER_MARK = {a: regex.compile(f"[{regex.escape(a + b)}]") for a, b in _OPEN.items()}
_QUOTES = "\"「『“„«‹‘"
#: What a scan stops at: openers, closers, quotes, code spans, terminators, and a space between Thai, Lao or Khmer letters.
_MARK = regex.compile(
    r"(?P<term>(?:\p{SB=ATerm}|\p{SB=STerm}|…)+)|(?P<open>[(\[{（［【「『《〈“„«‹])|(?P<code>`+)|(?P<quote>\")"
    r"|(?P<gap>(?<=[\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}])\s+(?=[\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]))"
)
_CLOSE = regex.compile(r"(?:[\p{SB=Close}’'\"*_](?<![(\[{（［【「『《〈“„«‹]))*")
_WORD_BEFORE = regex.compile(r"[\p{L}\p{M}]+(?:\.[\p{L}\p{M}]+)*$")
_NAME = regex.compile(r"[\p{Ll}]+-\d|`|\p{Lu}|\p{Lt}|[\"“„«‹‘¿¡(\[]|\d|[#*]")
_BEGINS = regex.compile(r"\p{Lu}|\p{Ll}+-\d|[\"“„«¿¡]")
_SEAT, _LETTERS, _DAY = regex.compile(r"\p{Ll}+-\d"), regex.compile(r"[\p{L}\p{M}]+"), regex.compile(r"(?<![\d.,:])\d{1,2}$")
_COUNTED = regex.compile(r"[(#§]?\d|[IVXLC]+\b|§")
_IN_ADDRESS = regex.compile(r"[\p{L}\p{N}=&/_\-]")
_ENDED = regex.compile(r"(?:\p{SB=ATerm}|\p{SB=STerm}|…)[\p{SB=Close}'’]*$")
_AFTER_BRACKET, _AFTER_QUOTE = regex.compile(r"\p{Lu}|\p{Lo}|[\"“„«]"), regex.compile(r"\p{Ll}+-\d|`|\p{Lu}|\p{Lt}|\p{Lo}|[\"“„«‹‘¿¡(\[]|\d")
_TERM = regex.compile(r"\p{SB=ATerm}|\p{SB=STerm}")
_TICKS, _LOW_CLOSE, _GAP = regex.compile("`+"), regex.compile("[“”]"), regex.compile(r"\s*")
_UNSPACED = regex.compile(r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Hangul}]")


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether it is one unit (heading, list item, fenced block) of each block of a text; blank lines end paragraphs."""
    para = fence = None
    at, last = 0, ""
    item: int | None = None  # start of an open list item
    item_end = 0
    for line in text.splitlines(keepends=True) if "\r" in text else (x + "\n" for x in text.split("\n")):
        end = min(at + len(line), len(text))
        body = line.rstrip("\r\n")
        if fence is not None:
            if body.strip().startswith(fence[1]) and not body.strip().strip(fence[1][0]):
                yield fence[0], end, True
                fence = None
            at = end
            continue
        if item is not None:
            if body[:2].isspace() and body.strip() and not _ITEM.match(body) and not _FENCE.match(body):
                item_end, at = end, end
                continue
            yield item, item_end, True
            item, last = None, "item"
        opens = _FENCE.match(body)
        is_item = _ITEM.match(body) and not (para is not None and _NUMBERED.match(body))
        if opens or _HEAD.match(body) or is_item or _BLANK.match(body):
            if para is not None:
                yield para, at, False
                para = None
            if opens:
                fence = (at, opens[1])
            elif is_item:
                item, item_end = at, end
            elif _HEAD.match(body):
                yield at, end, True
        elif para is None:
            para = at
        at = end
    if fence is not None:
        yield fence[0], len(text), True
    if item is not None:
        yield item, item_end, True
    if para is not None:
        yield para, len(text), False


class _Paragraph:
    """A paragraph's text and what is looked up in it more than once; all looks back go on where the last one ended, so they are linear together."""

    def __init__(self, t: str, hint: str | None = None) -> None:
        self.t, self.brackets, self.missing = t, {}, set()
        self.hint, self.own = frozenset([hint]) & _ALL, None
        self.token_at = self.token = self.unspaced_at = self.term = 0

    def partner(self, at: int) -> int:
        """Where what is opened at ``at`` closes (its end), however far that is, or -1; each kind of bracket is paired once with a stack, a mark that isn't found isn't sought again."""
        t, c = self.t, self.t[at]
        if c in "`\"„":
            mark = _TICKS.match(t, at)[0] if c == "`" else c
            if mark in self.missing:
                return -1
            if c == "„":  # closes with either mark
                m = _LOW_CLOSE.search(t, at + 1)
                close = m.end() if m else -1
            else:
                close = t.find(mark, at + len(mark))
                close = close + len(mark) if close > 0 else -1
            if close < 0:
                self.missing.add(mark)
            return close
        if c not in self.brackets:
            self.brackets[c] = self._paired(c, _OPEN[c])
        return self.brackets[c].get(at, -1)

    def _paired(self, opens: str, closes: str) -> dict[int, int]:
        out, stack = {}, []
        for m in _EITHER_MARK[opens].finditer(self.t):
            if m[0] == opens:
                stack.append(m.start())
            elif stack:
                out[stack.pop()] = m.end()
        return out

    def in_address(self, at: int) -> bool:
        """Whether the blank-free stretch up to ``at`` is an address."""
        blank = max(self.t.rfind(c, self.token_at, at) for c in " \n\t\u3000")
        self.token, self.token_at = max(self.token, blank + 1), at
        return self.t.find("://", self.token, at) >= 0

    def unspaced(self, start: int, at: int) -> bool:
        """Whether a letter of a script without spaces stands between."""
        m = _UNSPACED.search(self.t, max(start, self.unspaced_at), at)
        self.unspaced_at = m.start() if m else at
        return m is not None

    def _spoken(self, a: int, b: int) -> frozenset[str]:
        seen: dict[str, int] = {}
        for m in _LETTERS.finditer(self.t, a, b):
            for k in _FUNCTION.get(m[0].lower(), ()):
                seen[k] = seen.get(k, 0) + 1
        most = max(seen.values(), default=0)
        return frozenset(k for k, n in seen.items() if 2 * n > most)

    def languages(self, at: int, after: int) -> frozenset[str]:
        """The languages that may be spoken at a stop: by the function words from the stop before to the one behind it, else by those of the paragraph, else as the document says, else any."""
        behind = _TERM.search(self.t, after)
        near = self._spoken(self.term, behind.start() if behind else len(self.t))
        if not near:
            if self.own is None:
                self.own = self._spoken(0, len(self.t))
            near = self.own
        return (near or self.hint or _ALL) | {"hi", "ar"}

    def stops(self, sentence: int, start: int, end: int, after: int) -> bool:
        """Whether the terminator ``t[start:end]``, with its closing marks to ``after``, ends the sentence that began at ``sentence``."""
        t = self.t
        ahead = _GAP.match(t, after).end()
        if ahead == len(t):
            return True
        last, spaced = t[end - 1], ahead > after
        if last in ".․﹒．…":
            if last == "…" or end - start > 1 and set(t[start:end]) <= {"…", "."}:
                # an ellipsis ends a sentence if what follows begins one
                return spaced and _NAME.match(t, ahead) is not None
            if not spaced:
                return last == "．" or start > 0 and _UNSPACED.match(t, ahead) is not None and _UNSPACED.match(t, start - 1) is not None
            if after > end:
                return True
            w = _WORD_BEFORE.search(t, max(0, start - 24), start)
            if not w:
                month = _LETTERS.match(t, ahead)
                return not (month and month[0].lower() in _MONTHS and _DAY.search(t[max(0, start - 4) : start]))
            word = w[0].lower()
            if word not in _ABBREVIATED and len(word) > 1:
                return True
            if t[w.start() - 1 : w.start()] in ("-", "_", "/", "@") and w.start():
                return True
            return self._abbreviated(w[0], word, start, after, ahead)
        if t[ahead] in ",;:，；：、":
            return False
        # ASCII marks inside addresses and code: letters follow without a space
        if last in "?!" and not spaced and after == end:
            if _UNSPACED.match(t, ahead) or not _IN_ADDRESS.match(t, ahead):
                return True
            # nor do they follow one in scripts without spaces, save inside an address
            return self.unspaced(sentence, start) and not self.in_address(start)
        return True

    def _abbreviated(self, as_written: str, word: str, start: int, after: int, ahead: int) -> bool:
        """Whether a sentence ends after a word that may be an abbreviation, in the languages spoken here."""
        spoken = self.languages(start, after)
        kinds = {k for k, words in _KINDS.items() if words.get(word, frozenset()) & spoken}
        m = _LETTERS.match(self.t, ahead)
        begins = bool(m and m[0][:1].isupper() and len(m[0]) > 1 and _FUNCTION.get(m[0].lower(), frozenset()) & spoken) or _SEAT.match(self.t, ahead) is not None
        if "title" in kinds and (as_written[0] != as_written[0].lower() or not word.isascii()):
            return False
        if "lead" in kinds:
            return False
        if ("numbered" in kinds or "word" in kinds) and _COUNTED.match(self.t, ahead):
            return False
        if "numbered" in kinds or len(word) == 1:
            # an initial, or a letter of a spaced abbreviation
            return begins
        if "either" in kinds:
            return _BEGINS.match(self.t, ahead) is not None
        return True


def sentences(t: str, hint: str | None = None) -> Iterator[tuple[int, int]]:
    """Spans of the sentences of a paragraph; ``hint``: the language its document is said to be in."""
    start = i = 0
    p = _Paragraph(t, hint)
    while m := _MARK.search(t, i):
        kind, at, end = m.lastgroup, m.start(), m.end()
        if kind == "gap":
            yield start, at
            start = i = end
            continue
        if kind == "term":
            # an opening quote that looks like a closing one: it stands after a space
            i = after = _CLOSE.match(t, end).end()
            if p.stops(start, at, end, after):
                yield start, after
                start = after
            p.term = end
            continue
        close = p.partner(at)
        if close < 0:
            i = end
            continue
        i = close
        c, inside = t[at], t[at + 1 : close - 1].rstrip()
        if c == "`" or not inside or not _ENDED.search(inside):
            continue
        after = _CLOSE.match(t, close).end()
        ahead = _GAP.match(t, after).end()
        over, spaced = ahead == len(t), ahead > after
        if c not in _QUOTES:
            # a bracket with whole sentences is one only where nothing stands before it
            stop = _GAP.match(t, start).end() >= at and (over or spaced and _AFTER_BRACKET.match(t, ahead) is not None)
        elif over:
            stop = True
        elif t[ahead] in ",;:，；：、.。!?！？।":
            stop = False
        elif not spaced:
            stop = False  # scripts without spaces: words right after a quotation go on with it
        elif t[start:at].rstrip()[-1:] in (":", "："):
            stop = True  # what was announced has been said
        else:
            # words in lower case go on; a name, a capital, or a script without case begins anew
            stop = _AFTER_QUOTE.match(t, ahead) is not None
        if stop:
            yield start, after
            start = i = after
    yield start, len(t)


def spans(text: str, hint: str | None = None) -> list[tuple[int, int]]:
    """All sentence units of a text in order: start and end in code points, without outer white space."""
    out = []
    for a, b, unit in blocks(text):
        part = text[a:b]
        for x, y in [(0, b - a)] if unit else sentences(part, hint):
            left = _LEFT.match(part, x, y).end()
            if left < y:
                while part[y - 1].isspace() or part[y - 1] in "​﻿":
                    y -= 1
                out.append((a + left, a + y))
    return out


def split(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_no, sent_start, sent_end, sentence`` of every document; null and blank texts have none.

    Every text is taken whole, one document at a time: there is no shuffle, and a task holds one batch of texts. A column ``lang``, which
    may be null, wrong or missing, is a hint where a text's own words don't tell its language.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, n, a, b, t[a:b]) for d, t, hint in zip(pdf["doc_id"], pdf["text"], pdf["hint"], strict=True) for n, (a, b) in enumerate(spans(t, hint))]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_no", "sent_start", "sent_end", "sentence"])

    hint = F.lower(F.substring("lang", 1, 2)) if "lang" in docs.columns else F.lit(None).cast("string")
    known = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", hint.alias("hint"))
    return known.mapInPandas(run, "doc_id bigint, sent_no bigint, sent_start bigint, sent_end bigint, sentence string")
