"""Problem 3: personal information in free text, found and replaced by typed placeholders.

Values with a form (mailboxes, phones, identity numbers, street addresses) are recognised by it. For names there is no form: any two
capitalised words may be one. Following information-theoretic sanitisation, the corpus tells: words that stand next to protected
values, titles or initials, or inside mailboxes, are counted, and so are the slots (what stands left and right of
a term). A term whose words and slot disclose a person, in bits of log-odds, beyond the threshold is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import regex as re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.session import cut
from colloquy.sources.tables import is_blank

KINDS = ["email", "phone", "identity_number", "street_address", "person_name"]
#: Bits above which a term is taken to disclose a person.
THRESHOLD = 0.0
#: A character is taken for a family name if so many different terms that begin with it stand beside protected values: a label stands there alone.
FAMILY_TERMS = 2

# Titles before a name, street words, and check characters of identity numbers.
TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Doctor|Sir|Madam|Señora|Señor|Señorita|Sra|Sr|Srta|Don|Doña|Herr|Frau|Mme|Mlle|Madame|Monsieur|Signor|Signora"
STREET = "Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Court|Ct|Close|Drive|Boulevard|Blvd|Way|Place|Pl|Square|Sq|Terrace|Crescent|Parkway|Pkwy|Highway|Hwy|Row|Walk|Mews|Grove|Gardens"
SPANISH_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
CHINESE_WEIGHTS, CHINESE_LETTERS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2), "10X98765432"

#: A letter, digit or underscore of a script that writes blanks between words: in others a value begins right after a word.
_L = r"\p{Latin}\p{Greek}\p{Cyrillic}\p{N}_"
_A = r"\p{Latin}\p{Greek}\p{Cyrillic}"
_DOT = r"(?:\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s|\.)"
_EMAIL = re.compile(rf"(?<![{_L}.+%/:@-])(?P<local>[{_L}][{_L}.+'-]*)(?:[@＠]|%40)(?P<host>(?:[{_L}-]+\.)+[A-Za-z]{{2,}})(?![{_L}@])(?!:[{_L}/~])", re.I)
_EMAIL_IN_MARKS = re.compile(rf"(?<![{_L}.+-])[{_L}][{_L}.+-]*\s?[\[({{]\s?at\s?[\])}}]\s?[{_L}-]+(?:{_DOT}[{_L}-]+)+", re.I)
_EMAIL_IN_WORDS = re.compile(rf"(?<![{_L}.+-])[{_L}][{_L}.+-]* at [{_L}-]+(?: dot [{_L}-]+)+", re.I)
_AT_IN_MARKS = re.compile(r"[\[({]\s?at\s?[\])}]", re.I)
_PHONE = re.compile(
    rf"(?<![{_L}.+/-])"
    r"(?:(?:tel:)?\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,5}|00\d{1,3}(?:[ .-]\d{2,5}){2,4}|\(0?\d{2,4}\) ?\d{3,4}[ .-]?\d{4}|\d{3}([.-])\d{3}\1\d{4}"
    r"|0\d(?:[ .]\d\d){4}|0\d{3,4} \d{3} ?\d{3,4}|0\d{2,3}-\d{7,8}|1[3-9]\d(?:[ -]?\d{4}){2})"
    rf"(?![{_L}-]|\.\d)"
)
_IDENTITY = re.compile(rf"(?<![{_L}-])" r"(?:\d{3}([ -])\d\d\1\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|\d{8}-?[A-Z]|\d{17}[\dXx]|[A-Z]\d{8})" rf"(?![{_L}-])")
_CITY = r"(?:(?:,\s?|\n)\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?(?: \d{5})?)?(?:,? ?(?:Apt|Flat|Unit)\.? \d+)?"
_ADDRESS = re.compile(
    rf"(?:(?:Flat|Apt|Unit|Suite)\.? \d+, )?(?<![{_L}.])\d{{1,5}}[a-zA-Z]? (?:\p{{Lu}}[{_A}'’-]+\s){{1,3}}(?i:{STREET})\b\.?{_CITY}"
    rf"|(?:(?:Am|An der|Im|In der|Zum|Zur|Auf dem|Unter den|Alte[rs]?|Neue[rs]?|Große|Kleine) )?\p{{Lu}}[{_A}-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|ufer|damm) \d{{1,4}}[a-z]?\b(?:, \d{{5}} \p{{Lu}}\p{{Ll}}+)?"
    r"|(?:(?:Am|An der|Im|In der|Zum|Zur|Auf dem|Alte[rs]?|Neue[rs]?) )?\p{Lu}\p{Ll}+ \d{1,4}[a-z]?, \d{5} \p{Lu}\p{Ll}+"
    r"|\b(?:Calle|Avenida|Avda\.?|Av\.|Plaza|Paseo|Camino|Carrera|Rua|Via|Viale|Piazza)\s(?:(?:de|del|la|las|los|el|da|do|di)\s)*\p{Lu}['’\p{Latin}]+(?: \p{Latin}+){0,3},? (?:n\.?º ?)?\d{1,4}(?:, \d{1,2}º(?: ?[A-Z])?)?"
    rf"|(?<![{_L}.])" r"\d{1,4}(?: ?bis| ?ter)?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai) (?:(?:de|du|des|la|le|les) |[ld]['’])*\p{Lu}['’\p{Latin}-]+"
    r"|[\p{Han}]{2,12}?(?:路|街|巷|道|胡同|弄)\d{1,5}号(?:\d+(?:单元|楼|栋|室|层))*"
)
_CAP = r"\p{Lu}[\p{Ll}'’]*\p{Ll}(?:-\p{Lu}\p{Ll}+)*"
_CAPS = r"\p{Lu}[\p{Lu}'’]+\p{Lu}(?:-\p{Lu}{2,})*"
_TITLED = re.compile(rf"(?<![{_L}])(?:{TITLES})\.? (?:(?:{TITLES})\.? |\p{{Lu}}\. )*(?:{_CAP})(?: {_CAP})?|[\p{{Han}}]{{1,3}}(?:先生|女士|小姐|老师|博士|教授)")
_INITIAL = re.compile(rf"(?<![{_L}.])\p{{Lu}}\. (?:\p{{Lu}}\. )*(?:{_CAP})(?![{_L}])")
_RUN = re.compile(rf"(?<![{_L}`/.-])(?<!\w['’])(?:{_CAP}(?:(?:,? | \p{{Lu}}\.? ){_CAP})+|{_CAPS}(?:,? | \p{{Lu}}\.? ){_CAPS}(?! ?{_CAPS})|(?<![\p{{Han}}])[\p{{Han}}]{{2,4}}(?![\p{{Han}}]))(?![{_L}`])")
_PART = re.compile(rf"{_CAP}|{_CAPS}|[\p{{Han}}]+")
_LEFT, _RIGHT = re.compile(r"(?:\S{1,12}|\S{0,12}\n)\s?$"), re.compile(r"^\s?(?:'s\b|[^\w\s]{1,2}|\w{1,10})|^$")
_MASK = re.compile(r"\d+")


def _identity(s: str) -> bool:
    s = re.sub(r"[ -]", "", s).upper()
    if len(s) == 9 and s[:8].isdigit() and s[8].isalpha():
        return SPANISH_LETTERS[int(s[:8]) % 23] == s[8]
    if len(s) == 18:
        date = 1900 <= int(s[6:10]) <= 2099 and 1 <= int(s[10:12]) <= 12 and 1 <= int(s[12:14]) <= 31
        return date and CHINESE_LETTERS[sum(int(a) * w for a, w in zip(s, CHINESE_WEIGHTS, strict=False)) % 11] == s[17]
    return True


def _phone(s: str) -> bool:
    return 8 <= sum(c.isdigit() for c in s) <= 15


def formed(t: str) -> list[tuple[str, int, int]]:
    """Kind and span of every value with a form; of overlapping ones the first kind in this order: mailbox, identity number, address, phone."""
    out: list[tuple[str, int, int]] = []

    def add(kind: str, m) -> None:
        if not any(a < m.end() and m.start() < b for _, a, b in out):
            out.append((kind, *m.span()))

    # each pattern is tried where the text holds the mark that it can't do without
    if "@" in t or "＠" in t or "%40" in t:
        for m in _EMAIL.finditer(t):
            if m["local"].lower() != "git" and not m["host"].split(".")[0].isdigit():
                add("email", m)
    if ("[" in t or "(" in t or "{" in t) and _AT_IN_MARKS.search(t):
        for m in _EMAIL_IN_MARKS.finditer(t):
            add("email", m)
    if " dot " in t.lower():
        for m in _EMAIL_IN_WORDS.finditer(t):
            add("email", m)
    if any(c.isdigit() for c in t):
        for m in _IDENTITY.finditer(t):
            if _identity(m[0]):
                add("identity_number", m)
        for m in _ADDRESS.finditer(t):
            add("street_address", m)
        for m in _PHONE.finditer(t):
            if _phone(m[0]):
                add("phone", m)
    return out


def _slot(t: str, a: int, b: int) -> str:
    left, right = _LEFT.search(t, max(0, a - 14), a), _RIGHT.match(t[b : b + 12])
    after = right[0].strip() if right else ""
    return _MASK.sub("9", f"{left[0].strip() if left else '^'}_{'X' if after[:1].isupper() else after}".lower())


def terms(t: str, values: list[tuple[str, int, int]]) -> Iterator[tuple[int, int, list[str], str, bool]]:
    """Span, words, slot and whether it is certain, of every term that may be a name; none inside a value with a form."""
    inside = lambda a, b: any(x < b and a < y for _, x, y in values)
    certain = [m.span() for p in (_TITLED, _INITIAL) for m in p.finditer(t) if not inside(*m.span())]
    for a, b in certain:
        yield a, b, [w for w in _PART.findall(t[a:b]) if w not in TITLES.split("|")], _slot(t, a, b), True
    taken = [*certain]
    for m in _RUN.finditer(t):
        parts = list(_PART.finditer(t, m.start(), m.end()))
        if len(parts) == 1:  # a run of Han characters
            a, b = m.span()
            if not inside(a, b) and not any(x < b and a < y for x, y in taken):
                yield a, b, [t[a], t[a:b]], _slot(t, a, b), _beside(t, a, b, values)
            continue
        # of a longer run every two neighbours may be the name, save the word that begins a sentence before a comma pair
        pairs = [(x, y) for x, y in zip(parts, parts[1:], strict=False)]
        for x, y in pairs:
            a, b = x.start(), y.end()
            if not inside(a, b) and not any(p < b and a < q for p, q in taken):
                yield a, b, [x[0], y[0]], _slot(t, a, b), _beside(t, a, b, values)


def _beside(t: str, a: int, b: int, values: list[tuple[str, int, int]]) -> bool:
    """Whether a protected value stands right beside, with at most a few marks between."""
    return any((b <= x <= b + 8 and not any(c.isalpha() for c in t[b:x].replace("TEL", ""))) or (y <= a <= y + 4 and not any(c.isalpha() for c in t[y:a])) for k, x, y in values if k != "street_address")


SCAN = "source_table string, record_key string, field_name string, part int, kind string, a int, b int, words array<string>, slot string, certain boolean"


def _read(source: str, body: str) -> Iterator[tuple[str, int, str]]:
    """Field name, number and text of the free texts of a row."""
    if source == "room":
        yield "content", 0, body
        return
    try:
        line = json.loads(body)
    except ValueError:
        return
    n = 0
    for event in line if isinstance(line, list) else [line]:
        item = event.get("item") if isinstance(event, dict) else None
        if isinstance(item, str):
            try:
                item = json.loads(item)
            except ValueError:
                continue
        if not isinstance(item, dict):
            continue
        for f in ("command", "aggregated_output"):
            v = item.get(f)
            if v is not None:
                yield f"item.{f}", n, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        n += 1


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCAN.split(", ")]
    for pdf in batches:
        rows = []
        for source, key, body in zip(pdf["source_table"], pdf["record_key"], pdf["body"], strict=True):
            for field, part, t in _read(source, body):
                values = formed(t)
                at = (source, key, field, part)
                rows += [(*at, k, a, b, None, None, True) for k, a, b in values]
                for k, a, b in values:
                    if k == "email":
                        words = re.findall(r"\p{L}{4,}", re.split(r"[@＠%\[({ ]", t[a:b])[0].lower())
                        if words:
                            rows.append((*at, "mailbox", a, b, words, None, True))
                rows += [(*at, "person_name", a, b, [w.lower() for w in ws], slot, sure) for a, b, ws, slot, sure in terms(t, values)]
        yield pd.DataFrame(rows, columns=names).astype({"part": "int32", "a": "int32", "b": "int32"})


def texts(room: DataFrame, turn_lines: DataFrame) -> DataFrame:
    """``source_table, record_key, body``: each post's content and each raw line with a command or an output."""
    posts = room.where("id is not null and content is not null").select(F.lit("room").alias("source_table"), F.col("id").alias("record_key"), F.col("content").alias("body"))
    lines = turn_lines.where("line_id is not null").where(F.col("line").contains("command") | F.col("line").contains("aggregated_output"))
    return posts.unionByName(lines.select(F.lit("turn_lines").alias("source_table"), F.col("line_id").cast("string").alias("record_key"), F.col("line").alias("body")))


def scan(room: DataFrame, turn_lines: DataFrame) -> DataFrame:
    """All values with a form and all terms that may be names, with their spans; repeated rows count once."""
    t = texts(room, turn_lines)
    return t.mapInPandas(_scan, SCAN).dropDuplicates(["source_table", "record_key", "field_name", "part", "kind", "a", "b"])


def names(found: DataFrame) -> DataFrame:
    """The terms of ``scan`` that disclose a person, with their ``bits``.

    A word's bits: the odds of standing beside protected values, titles or initials, or in mailboxes, against standing elsewhere. A slot's
    bits: the odds that its terms hold such words. Words never seen elsewhere count next to nothing, so the slot decides.
    """
    t = found.where("kind = 'person_name'")
    # a name in Han characters begins with a family name, which the corpus shows by its company: as many characters as the script has, not as rows
    han = (F.size("words") == 2) & (F.length(F.get("words", F.lit(0))) == 1)
    heads = t.where(han & F.col("certain")).groupBy(F.get("words", F.lit(0)).alias("head")).agg(F.count_distinct(F.get("words", F.lit(1))).alias("n")).where(F.col("n") >= FAMILY_TERMS).select("head")
    t = t.where(~han).unionByName(t.where(han).join(heads, F.get("words", F.lit(0)) == F.col("head"), "left_semi"))
    sure = t.where("certain")
    open_ = t.where("not certain")
    said = found.where("kind = 'mailbox'").select("words", F.lit(True).alias("certain")).unionByName(t.select("words", "certain"))
    w = said.select(F.explode(F.array_distinct("words")).alias("word"), "certain").groupBy("word")
    w = w.agg(F.count_if("certain").alias("yes"), F.count_if(~F.col("certain")).alias("no"))
    w = w.select("word", (F.col("yes") >= 1).alias("known"), F.log2((F.col("yes") + 0.5) / (0.2 * F.col("no") + 0.5)).alias("bits"))
    key = ["source_table", "record_key", "field_name", "part", "a", "b"]
    each = open_.select(*key, "slot", F.explode(F.array_distinct("words")).alias("word")).join(w, "word")
    per = each.groupBy(*key, "slot").agg(F.sum("bits").alias("bits"), F.bool_or("known").alias("known"))
    slots = per.groupBy("slot").agg(F.count_if("known").alias("yes"), F.count_if(~F.col("known")).alias("no"))
    slots = slots.select("slot", F.log2((F.col("yes") + 0.5) / (0.5 * F.col("no") + 0.5)).alias("slot_bits"))
    disclosed = per.join(slots, "slot").withColumn("bits", F.col("bits") + F.col("slot_bits")).where(F.col("bits") > THRESHOLD)
    return disclosed.select(*key, "bits").unionByName(sure.select(*key, F.lit(None).cast("double").alias("bits")))


def spans(room: DataFrame, turn_lines: DataFrame) -> DataFrame:
    """``source_table, record_key, field_name, part, kind, a, b, bits``: all personal information, by place; ``bits`` is null where no estimate was needed."""
    s = cut(scan(room, turn_lines))
    key = ["source_table", "record_key", "field_name", "part"]
    formed_ = s.where(F.col("kind").isin("email", "phone", "identity_number", "street_address")).select(*key, "kind", "a", "b", F.lit(None).cast("double").alias("bits"))
    return formed_.unionByName(names(s).select(*key, F.lit("person_name").alias("kind"), "a", "b", "bits"))


def found(room: DataFrame, turn_lines: DataFrame) -> DataFrame:
    """``source_table, record_key, field_name, kind`` of every field with at least one value of the kind.

    Null, blank and broken texts hold nothing; a repeated post or line is one record.
    """
    return spans(room, turn_lines).select("source_table", "record_key", "field_name", "kind").distinct()


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for source, key, body, hits in zip(pdf["source_table"], pdf["record_key"], pdf["body"], pdf["hits"], strict=True):
            by: dict[tuple[str, int], list] = {}
            for h in hits if hits is not None else ():
                by.setdefault((h["field_name"], h["part"]), []).append((-99.0 if h["bits"] is None else -h["bits"], h["a"], h["b"], h["kind"]))
            for field, part, t in _read(source, body):
                # of overlapping values the one that discloses most
                chosen: list[tuple[int, int, str]] = []
                for _, a, b, kind in sorted(by.get((field, part), ())):
                    if not any(x < b and a < y for x, y, _ in chosen):
                        chosen.append((a, b, kind))
                out, at = [], 0
                for a, b, kind in sorted(chosen):
                    out += [t[at:a], f"[{kind.upper()}]"]
                    at = b
                rows.append((source, key, field, part, "".join([*out, t[at:]])))
        yield pd.DataFrame(rows, columns=["source_table", "record_key", "field_name", "part", "text"])


def redacted(room: DataFrame, turn_lines: DataFrame) -> DataFrame:
    """Every free text with a typed placeholder for each value, otherwise unchanged: ``source_table, record_key, field_name, part, text``."""
    s = spans(room, turn_lines).groupBy("source_table", "record_key").agg(F.collect_list(F.struct("field_name", "part", "kind", "a", "b", "bits")).alias("hits"))
    t = texts(room, turn_lines).where(~is_blank(F.col("body"))).dropDuplicates(["source_table", "record_key"])
    return t.join(s, ["source_table", "record_key"], "left").mapInPandas(_replace, "source_table string, record_key string, field_name string, part int, text string")
