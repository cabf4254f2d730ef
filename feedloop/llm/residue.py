"""Template residue and error-page text: aligned templates, their slots, filler, and repeated whole-page messages.

A record is cut to units (cues, or lines where there are no times). One pass over all units of all records aligns them:

- by a key that masks what differs between records of one template (numbers, ids, letter case). Page templates are keys that stand in a page's place
  (in records without times, after the last cue, within a page's markup) under many groups, and seldom among cues. Dummy captions are keys that stand
  in records whose captions count themselves, and seldom elsewhere.
- by a frame (a unit's first and last words), which induces slots: the place between them where records of one template differ. A notation in which
  names stand in such places, where aligned units have plain words, and whose names occur in other notations too, is one of templates; its names, and
  those of the public template languages, are then also found in brackets that subtitles use for other things. A frame in which names stood has its slot
  known, so defaults and blanks kept there are found as well.

What is learnt is small (it counts templates, not records); public lists and a lexicon find what is too rare in a corpus to be learnt.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloop.llm.notices import BETWEEN, MARKUP, Judge, letters
from feedloop.session import cut

# --- Fixed values -----------------------------------------------------------------------------------------------------
#: Words by which a bracket asks to be filled in.
FILL_IN = re.compile(
    r"(?i)\b(?:insert\w*|insér\w*|inser\w*|einfügen|einfuegen|your|goes here|here|tbd|tba|todo|tbc|fill in|placeholder|add|enter|replace|type|"
    r"speaker name|translator|translator name|episode title|title|show name|nom du|nombre del?|nome do|nome del|titre du|titel|texto|texte|"
    r"имя|вставьте|вставить|wstaw|buraya|ekle)\b"
)
#: Tags of markup that subtitles and pages use.
TAGS = frozenset(
    "i b u s em strong font span br p div a c v lang ruby rt html head title body center h1 h2 h3 h4 hr noscript script style meta "
    "link img table tr td ul li ol pre code form input button iframe svg nav header footer section article xml error requestid tt "
    "sync sami k small big sub sup q blockquote label main".split()
)

# --- Slots ------------------------------------------------------------------------------------------------------------
_NAME = r"[^\W\d_](?:[^\s{}<>%$|@\"'`=]{0,48}[^\s{}<>%$|@\"'`=:,;!?])?"
#: Notations of public template languages, by what they open with; the first group is the name. Others are induced from a corpus.
#: Each begins with its opening, and looks back only after it, so that the search skips quickly.
SLOTS = tuple(
    (opening, re.compile(pattern))
    for opening, pattern in (
        ("{{", r"\{\{[#/^&>~]?\s*([^\s{}|]{1,50}(?:\s[^\s{}|]{1,50})?)\s*(?:\|[^{}\n]{0,30})?\}\}"),
        ("{%", r"\{%-?\s*\w+\s*([^%\n]{0,60})%\}"),
        ("${", r"\$\{\s*([^\s{}]{1,50})\s*\}"),
        ("#{", r"#\{\s*([^\s{}]{1,50})\s*\}"),
        ("<%", r"<%[=\-#]?\s*([^\s%]{1,50})\s*%>"),
        ("<?", r"<\?(?:php|=)\s*(?:echo\s+)?\$?([^\s;?]{1,50})"),
        ("%(", r"%\(([^\s()]{1,50})\)[sdrf]"),
        ("[[", r"\[\[([^\s\[\]]{1,50}(?:\[\d+\])?)\]\]"),
        ("%", rf"%({_NAME})%"),
        ("$", rf"\$(?<![\w$]\$)({_NAME})\$"),
        ("__", r"__(?<!\w__)([^\W_][^\s]{0,48}?)__(?!\w)"),
        ("{", r"\{(?<![{\\]\{)([^\W\d_][\w.\-]{1,48}(?:\[\d+\])?|\d{1,2})\}(?!\{)"),
    )
)
#: Brackets and braces that subtitles use as well.
BRACKET = re.compile(r"\[\s?([^\[\]<>{}\n|]{2,44}?(?:\[\d+\])?)\s?\]|<\s?([^\[\]<>{}\n|/!?%=][^\[\]<>{}\n|=\"”]{0,44}?(?:\[\d+\])?)\s?>|\{\s?([^\[\]<>{}\n|\\\";]{2,60}?)\s?\}")
_SLOTTY = re.compile(r"[{\[<%$@_~^|*#(«]")
#: What formatting codes look like that have lost their backslash.
_CODE = re.compile(r"^(?:an?\d{1,2}|[ibus][01]|fs\d+|pos|fad|k\d+)$")


_SPOILT = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]")


def _as_bytes(e: UnicodeError) -> tuple[bytes, int]:
    """Characters outside the one-byte encoding: as their own byte if they are one, else as UTF-8."""
    out = b"".join(bytes((ord(c),)) if ord(c) < 256 else c.encode("utf-8", "ignore") for c in e.object[e.start : e.end])
    return out, e.end


codecs.register_error("feedloop-bytes", _as_bytes)


def repair(text: str) -> str:
    """The text with UTF-8 that was read as a one-byte encoding, once or twice, set right; lost bytes stay lost."""
    for _ in range(2):
        if not _SPOILT.search(text):
            break
        better = text.encode("cp1252", "feedloop-bytes").decode("utf-8", "ignore")
        if len(better) > 0.97 * len(text) and len(_SPOILT.findall(better)) >= len(_SPOILT.findall(text)):
            break
        text = better
    return text


_WIDENED = re.compile("[＃｛［＜％＄＠＿]")


def plain(text: str) -> str:
    """The text with encodings set right, character references resolved and widened letters narrowed."""
    if "&" in text:
        text = html.unescape(text)
        if "&#" in text:
            text = html.unescape(text)
    if not text.isascii():
        text = repair(text)
        if _WIDENED.search(text):
            text = unicodedata.normalize("NFKC", text)
    return text


def slots(text: str) -> list[str]:
    """Names in notations that only templates use."""
    out = []
    for opening, pattern in SLOTS:
        if opening in text:
            out += [name for name in pattern.findall(text) if opening != "{" or not _CODE.match(name.lower())]
    return out


def fold_name(name: str) -> str:
    """A slot's name without case, separators and numbers."""
    return re.sub(r"[\W\d_]+", "", name.casefold())


def brackets(text: str) -> Iterator[tuple[str, bool]]:
    """(content, whether in angle brackets) of the brackets and braces that may be slots; markup and codes are left out."""
    for m in BRACKET.finditer(text):
        square, angle, brace = m.groups()
        if brace is not None and _CODE.match(brace.lower()):
            continue
        if angle is None:
            yield square or brace, False
            continue
        head = re.split(r"[\s.:]", angle, maxsplit=1)[0].lower()
        if head not in TAGS and not angle[0].isdigit() and re.search(r"[^\W\d_]", angle):
            yield angle, True


def names_shown(text: str, found: list[str]) -> list[str]:
    """Folded names that the text shows to be slots: those found in template notations, or in angle brackets of several words."""
    out = [fold_name(n) for n in found]
    out += [fold_name(b) for b, angle in brackets(text) if (angle and re.search(r"[^\W\d_]{2}[\s_.][^\W\d_]", b)) or FILL_IN.search(b)]
    return [n for n in out if len(n) > 2]


_EDGE = r"[{}\[\]<>()%$@#_~^|*«»§=+`]"
#: A name between marks of any kind, as one token.
MARK = re.compile(rf"({_EDGE}{_EDGE}{{0,3}}(?: [{{\[<(])?[=#/%]?\s?(?:\d{{1,3}}:\s?)?)([^\W\d_](?:[\w.\-]{{0,48}}[^\W_])?(?:\[\d+\])?)(\s?{_EDGE}{{1,4}}(?: [}}\]>)])?)")
_EDGED = re.compile(_EDGE)
#: What stands in a slot that was filled with nothing.
DEFAULTS = frozenset("undefined null none nil nan n/a tbd tba xxx ??? ___ ____ [] {} () <>".split())
#: The label of names that public template languages show.
PUBLIC = "public"


def marks(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(notation, folded name, start, end) of names between marks; markup is left out."""
    for m in MARK.finditer(text):
        before, name, after = m.groups()
        if before == "<" and re.split(r"[.\-]", name, maxsplit=1)[0].lower() in TAGS or _CODE.match(name.lower()):
            continue
        if "_" not in before:
            after = after.lstrip("_")
        folded = fold_name(name)
        if len(folded) > 2:
            yield re.sub(r"\d+", "#", f"{before.strip()}…{after.strip()}"), folded, m.start(), m.end()


# --- Units ------------------------------------------------------------------------------------------------------------
_CLOCK = r"\d{1,3}[:.]\d{2}(?:[:.,;]\d{1,3}){0,3}"
_GAP = r"[^\S\n]{0,8}"
#: Two clock times; a digit comes first so that the search skips quickly to digits.
_SPAN = re.compile(rf"\d\d{{0,2}}[:.]\d{{2}}(?:[:.,;]\d{{1,3}}){{0,3}}{_GAP}[-–—=>→<,~ ]{{1,8}}{_GAP}{_CLOCK}[^\n]*")
_BEFORE = re.compile(rf"{_GAP}\W{{0,3}}")
_ALONE = re.compile(rf"{_GAP}\d{{1,9}}{_GAP}")


def times(text: str) -> list[tuple[int, int]]:
    """Where the lines of times begin and end, each with the line of its number, if there is one."""
    out: list[tuple[int, int]] = []
    for m in _SPAN.finditer(text):
        at = m.start()
        line = text.rfind("\n", 0, at) + 1
        if line != at and not _BEFORE.fullmatch(text, line, at):
            continue
        if line:
            before = text.rfind("\n", 0, line - 1) + 1
            if line - before <= 26 and (text[before : line - 1].isdecimal() and line - before <= 10 or _ALONE.fullmatch(text, before, line - 1)) and (not out or before >= out[-1][1]):
                line = before
        out.append((line, m.end()))
    return out


_NUMBER_LINE = re.compile(r"^\W*\d{1,6}\W*$")


def units(text: str) -> tuple[list[str], list[str], bool]:
    """(cues, what follows the last cue after an empty line or a page's tag, whether there are times)."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _units(text, times(text))


def _units(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[str], bool]:
    if not spans:
        blocks = [b.strip() for b in re.split(r"\n[^\S\n]*\n", text) if b.strip()]
        if len(blocks) == 1:
            blocks = [line.strip() for line in blocks[0].split("\n") if line.strip()]
        return blocks, [], False
    cues: list[str] = []
    after: list[str] = []
    for k, (_, end) in enumerate(spans):
        body = text[end : spans[k + 1][0] if k + 1 < len(spans) else len(text)].strip("\n")
        if k + 1 == len(spans):
            parts = [p.strip() for p in re.split(r"\n[^\S\n]*\n", body)]
            after = [p for p in parts[1:] if p]
            body = parts[0]
        if "\n" in body or body.isdigit():
            body = "\n".join([line for line in body.split("\n") if line[:1].isalpha() or line.strip() and not _NUMBER_LINE.match(line)])
        cues.append(body.strip())
    return cues, after, True


_VARIES = re.compile(r"\b(?=[a-f]*\d)[0-9a-f]{4,}\b|[\d#]+")
_NUMBER = re.compile(r"[\d#]")


def unit_key(unit: str) -> str:
    """The unit with what differs between records of a template masked."""
    unit = unit.lower()
    if _NUMBER.search(unit):
        unit = _VARIES.sub("#", unit)
    return " ".join(unit.split())


def hashed(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def frames(words: list[str]) -> tuple[int, ...]:
    """Keys of a unit's frames: its first and last two words, and its first four."""
    if len(words) < 5:
        return ()
    first = words[0] + " " + words[1] + " "
    return hashed(first + words[-2] + " " + words[-1]), hashed(first + words[2] + " " + words[3] + " …")


#: A page template stands in a page's place in at least so many groups, and in this share of all records it occurs in.
PAGE_GROUPS, PAGE_SHARE = 4, 0.25
#: A dummy caption stands in records that count themselves in at least so many groups, and in this share of all records it occurs in.
DUMMY_GROUPS, DUMMY_SHARE = 4, 0.5
#: A notation is one of templates if names stand in slots at least so often, in this share of its framed uses, and this share of its names is known
#: from public template languages.
HELD, HELD_SHARE, NAMED_SHARE = 4, 0.2, 0.5
#: A slot is known if names of templates and plain words stood there in at least so many records.
SLOT_RECORDS = 3
#: Names, notations, slots, page templates and dummy captions of a corpus that can be sent to the tasks; more are refused.
KEPT = 200_000


class Learnt(NamedTuple):
    """What a corpus shows: names of slots, notations, frames with a slot, page templates, dummy captions."""

    names: frozenset[str] = frozenset()
    notations: frozenset[str] = frozenset()
    slots: frozenset[int] = frozenset()
    pages: frozenset[str] = frozenset()
    captions: frozenset[str] = frozenset()


def counts_itself(cues: list[str]) -> bool:
    """Whether captions hold their own place in the record, as numbered dummy captions do."""
    own = 0
    for k, c in enumerate(cues, 1):
        if str(k) in c and re.search(rf"(?<!\d){k}(?!\d)", c) and any(map(str.isalpha, c)):
            own += 1
    return own >= 3 and 4 * own >= len(cues)


def _parts(unit: str) -> list[str]:
    """What a unit in a page's place says, piece by piece."""
    if MARKUP.match(unit):
        return [p for p in BETWEEN.split(unit) if len(p) > 7]
    return [letters(unit)]


class _Counts:
    """What a batch of records shows, added up."""

    def __init__(self) -> None:
        self.cues: list[int] = []  # keys of units, once for each record
        self.plain: list[int] = []  # frames of units without a mark
        self.frames: Counter[tuple[int, str]] = Counter()
        self.names: Counter[tuple[str, str]] = Counter()
        self.pages: dict[tuple[int, int], str] = {}
        self.numbered: dict[tuple[int, int], str] = {}
        self.memo: dict[str, tuple[int, tuple[int, ...]]] = {}

    def add(self, raw: str, title: str | None) -> None:
        text = plain(raw).replace("\r\n", "\n").replace("\r", "\n")
        spans = times(text)
        cues, after, timed = _units(text, spans)
        every = [*cues, *after]
        marked: list[tuple[str, str]] = []
        open_slots: list[str] = []
        if _SLOTTY.search(text):
            open_slots = slots(text)
            marked = [(name, label) for label, name, _, _ in marks(text)]
            self.names.update({(n, PUBLIC) for n in names_shown(text, open_slots)}.union(marked))
        said: set[int] = set()
        memo, plain_frames = self.memo, self.plain
        for u in dict.fromkeys(every):
            if u:
                known = memo.get(u)
                if known is None:
                    key = unit_key(u)
                    known = memo[u] = (hashed(key), frames(key.split(" ")))
                said.add(known[0])
                found = next(marks(u), None) if marked and _EDGED.search(u) else None
                if found is None:
                    plain_frames += known[1]
                else:
                    label, _, start, end = found
                    left, right = unit_key(u[:start]).split(), unit_key(u[end:]).split()
                    if len(left) >= 2 and len(right) >= 2:
                        self.frames[frames([*left, "", *right])[0], label] += 1
                    if len(left) >= 4 and not right:
                        self.frames[frames([*left, ""])[1], label] += 1
        if timed:  # what stands before the first cue, and the lines of a cue, are no page either
            for u in cues:
                if "\n" in u:
                    for line in u.split("\n"):
                        known = memo.get(line)
                        said.add(hashed(unit_key(line)) if known is None else known[0])
            said.update(hashed(unit_key(line)) for line in text[: spans[0][0]].split("\n"))
        self.cues += said
        if title is None or open_slots:  # a template with open slots is no page
            return
        own = hashed(title)
        for u in after if timed else every:
            for part in _parts(u):
                self._show(self.pages, part, own)
        if timed:
            for u in cues:
                if ("<" in u or "{" in u) and MARKUP.match(u):
                    for part in _parts(u):
                        self._show(self.pages, part, own)
        if counts_itself(cues):
            for u in cues:
                self._show(self.numbered, letters(u), own)

    @staticmethod
    def _show(where: dict[tuple[int, int], str], part: str, own: int) -> None:
        key = unit_key(part)
        if sum(map(str.isalpha, key)) >= 3:
            where[hashed(key), own] = key

    def batches(self) -> Iterator[pa.RecordBatch]:
        for kind, found in ((0, self.cues), (4, self.plain)):
            if found:
                keys, n = np.unique(np.array(found, np.int64), return_counts=True)
                none = pa.nulls(len(keys))
                columns = (pa.array(np.full(len(keys), kind, np.int8)), pa.array(keys), none.cast(pa.int64()), none.cast(pa.string()), none.cast(pa.string()), pa.array(n.astype(np.int64)))
                yield pa.record_batch(list(columns), names=list(_ROW))
        rows: list[tuple] = [(1, k, g, None, s, 1) for (k, g), s in self.pages.items()]
        rows += [(2, k, g, None, s, 1) for (k, g), s in self.numbered.items()]
        rows += [(3, hashed(name), None, label, name, n) for (name, label), n in self.names.items()]
        rows += [(4, k, None, label, None, n) for (k, label), n in self.frames.items()]
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _ROW.values(), strict=True)], names=list(_ROW))


#: What the learning pass gives: what is counted (0 units, 1 pages, 2 captions, 3 names, 4 frames), by which key and group.
_ROW = {"kind": pa.int8(), "key": pa.int64(), "grp": pa.int64(), "label": pa.string(), "shown": pa.string(), "n": pa.int64()}


def learn(df: DataFrame, text: str, group: str) -> Learnt:
    """What all units of a corpus show, none left out; more than KEPT templates raise."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = _Counts()
            for raw, title in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw and not raw.isspace():
                    counts.add(raw, title)
            yield from counts.batches()

    schema = "kind tinyint, key bigint, grp bigint, label string, shown string, n bigint"
    rows = df.select(F.col(text).cast("string"), F.col(group).cast("string")).mapInArrow(kernel, schema)
    # One pass over the texts, several questions: their rows travel in one shuffle, added up before it.
    per = cut(rows.groupBy("kind", "key", "grp", "label", "shown").agg(F.sum("n").alias("n")))
    names = per.where("kind = 3").groupBy("key").agg(F.max("shown").alias("shown"), F.collect_list(F.struct("label", "n")).alias("uses"), F.sum("n").alias("n"))
    held = per.where("kind = 4").groupBy("key").agg(
        F.sum(F.when(F.col("label").isNull(), F.col("n")).otherwise(0)).alias("plain"),
        F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n"))).alias("uses"),
    ).where(F.size("uses") > 0)
    public = F.exists("uses", lambda u: u["label"] == PUBLIC)
    named = names.select(F.inline("uses"), public.alias("public")).select("label", F.lit(0).alias("held"), F.lit(0).alias("framed"), F.when(F.col("public"), F.col("n")).otherwise(0).alias("named"), "n")
    placed = held.select(F.inline("uses"), "plain").select("label", F.when(F.col("plain") > 0, F.col("n")).otherwise(0).alias("held"), F.col("n").alias("framed"), F.lit(0).alias("named"), F.lit(0).alias("n"))
    sums = named.unionByName(placed).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("held", "framed", "named", "n")))
    shows = sums.where((F.col("held") >= HELD) & (F.col("held") >= HELD_SHARE * F.col("framed")) & (F.col("named") >= NAMED_SHARE * F.col("n")) & (F.col("label") != PUBLIC))
    notations = [r["label"] for r in shows.limit(KEPT + 1).collect()]
    used = F.filter("uses", lambda u: u["label"].isin(PUBLIC, *notations))
    kept_names = names.where((F.size(used) > 0) & (F.col("n") >= 2)).select(F.lit("names").alias("what"), "shown", F.lit(None).cast("bigint").alias("key"))
    in_slot = F.aggregate(used, F.lit(0).cast("bigint"), lambda a, u: a + u["n"])
    kept_slots = held.where((F.col("plain") >= SLOT_RECORDS) & (in_slot >= SLOT_RECORDS)).select(F.lit("slots").alias("what"), F.lit(None).cast("string").alias("shown"), "key")
    by_unit = per.where("kind <= 2").groupBy("key").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(0)).alias("n"), F.count_if(F.col("kind") == 1).alias("pages"),
        F.count_if(F.col("kind") == 2).alias("numbered"), F.max("shown").alias("shown"),
    )
    page = (F.col("pages") >= PAGE_GROUPS) & (F.col("pages") >= PAGE_SHARE * F.col("n"))
    caption = (F.col("numbered") >= DUMMY_GROUPS) & (F.col("numbered") >= DUMMY_SHARE * F.col("n"))
    kept_units = by_unit.where(page | caption).select(F.when(page, "pages").otherwise("captions").alias("what"), "shown", F.lit(None).cast("bigint").alias("key"))
    found = kept_names.unionByName(kept_slots).unionByName(kept_units).limit(KEPT + 1).collect()
    if len(found) + len(notations) > KEPT:
        raise ValueError(f"more than {KEPT} slot names, slots and templates in the corpus; raise residue.KEPT")
    of = lambda what: frozenset(r["shown"] for r in found if r["what"] == what)
    return Learnt(of("names"), frozenset(notations), frozenset(r["key"] for r in found if r["what"] == "slots"), of("pages"), of("captions"))


class Reader:
    """Judges records by what was learnt."""

    def __init__(self, learnt: Learnt) -> None:
        self.learnt = learnt
        self.judge = Judge(learnt.pages, learnt.captions)

    def _open_slot(self, text: str) -> bool:
        """Whether a name or an instruction of a template was left in the text."""
        if slots(text):
            return True
        names, notations = self.learnt.names, self.learnt.notations
        if notations and any(label in notations for label, _, _, _ in marks(text)):
            return True
        for content, angle in brackets(text):
            name = fold_name(content)
            if len(name) > 2 and (name in names or FILL_IN.search(content) or (angle and " " in content.strip())):
                return True
        return False

    def _unfilled(self, unit: str, last: bool) -> bool:
        """Whether a known slot of the unit's template holds a default, or nothing; at the end of a text it may be torn."""
        words = unit_key(unit).split(" ")
        n = len(words)
        if n != 4 and DEFAULTS.isdisjoint(words) or n < 4:
            return False
        inner, head = frames([*words[:2], "", *words[-2:]])[0], frames([*words[:4], ""])[1]
        empty = n == 4 or DEFAULTS.issuperset(words[2:-2])
        return (empty and inner in self.learnt.slots) or (n > 4 and DEFAULTS.issuperset(words[4:]) or n == 4 and not last) and head in self.learnt.slots

    def verdict(self, text: str | None) -> str | None:
        """Why the text is residue: "slot", "filler" or "page"; None if it isn't."""
        if not text or text.isspace():
            return None
        text = plain(text)
        if _SLOTTY.search(text) and self._open_slot(text):
            return "slot"
        cues, after, timed = units(text)
        cues = [c for c in cues if c]
        if self.learnt.slots and cues:
            defaults = not DEFAULTS.isdisjoint(text.lower().split())
            if any((defaults or c.count(" ") + c.count("\n") == 3) and self._unfilled(c, c is cues[-1]) for c in cues):
                return "slot"
        if cues and _most(self.judge.filler, cues):
            return "filler"
        message, alone = self.judge.message, self.judge.message_alone
        if any(alone(u) or ("\n" in u and any(map(message, u.split("\n")))) for u in after):
            return "page"
        # Bare markup between the messages doesn't count.
        said = [c for c in cues if c[0].isalpha() or any(map(str.isalpha, letters(c)))]
        if said and _most(message if timed else alone, said, half=True):
            return "page"
        last = cues[-1] if cues else ""
        return "page" if last and (message(last) or ("\n" in last and message(last.rsplit("\n", 1)[-1]))) else None


def _most(test: Callable[[str], bool], cues: list[str], half: bool = False) -> bool:
    """Whether the test holds for more than half of the cues, or for half of them."""
    allowed = len(cues) // 2 if half else (len(cues) - 1) // 2
    for c in cues:
        if not test(c):
            allowed -= 1
            if allowed < 0:
                return False
    return True


def residue(df: DataFrame, key: str, text: str, group: str) -> DataFrame:
    """``(key, residue)`` of each record: "slot", "filler" or "page"; null for records to keep.

    Null, empty and blank texts are not residue. Keys may be null or repeated; each row is judged by itself, so copies
    are judged alike. group is what a record belongs to (a title): a page template must occur under several of them.
    Other columns are ignored.
    """
    learnt = learn(df, text, group)
    kind = df.schema[key].dataType.simpleString()

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(learnt)
        for b in batches:
            found = [reader.verdict(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(found, pa.string())], names=["_key", "residue"])

    return df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(kernel, f"_key {kind}, residue string").withColumnRenamed("_key", key)


def without_residue(df: DataFrame, text: str, group: str) -> DataFrame:
    """The rows of df, with all their columns, whose text is no residue."""
    learnt = learn(df, text, group)
    at = df.columns.index(text)

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(learnt)
        for b in batches:
            yield b.filter(pa.array([reader.verdict(t) is None for t in b.column(at).to_pylist()], pa.bool_()))

    return df.mapInArrow(kernel, df.schema)
