"""License scans: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismata.llm.kernels import LOWER, NOT_ALNUM, SHORT_SLICE, text_slices, word_bounds, word_hashes
from prismata.llm.license_rules import SIGNATURES
from prismata.llm.scratch import small_batches

# Phrases that always count, and the label of each.
BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Label, keywords of which the lower-cased text must hold one (each match of the pattern holds one), pattern of the name.
LICENSES = (
    ("agpl", "affero", r"affero general public licen[cs]e"),
    ("lgpl", "lesser general|library general", r"(?:lesser|library) general public licen[cs]e"),
    ("gpl", "general public", r"general public licen[cs]e"),
    ("apache", "apache licen|apache software licen", r"apache (?:software )?licen[cs]e"),
    ("mit", "mit licen|mit/expat licen", r"\bmit(?:/expat)? licen[cs]e"),
    ("mit-0", "no attribution", r"mit no attribution(?: licen[cs]e)?"),
    ("bsd-4-clause", "clause bsd licen|original bsd licen", r"(?:original|4-clause|four[- ]clause) bsd licen[cs]e"),
    ("bsd-3-clause", "bsd licen", r"(?:3-clause|three[- ]clause|new|modified|revised) bsd licen[cs]e"),
    ("bsd-2-clause", "bsd licen|freebsd licen", r"(?:2-clause|two[- ]clause|simplified|freebsd) bsd licen[cs]e"),
    ("0bsd", "clause bsd", r"(?:zero[- ]clause|0-clause) bsd(?: licen[cs]e)?"),
    ("bsd", "bsd licen|bsd-style licen", r"\bbsd(?:-style)? licen[cs]e"),
    ("isc", "isc licen", r"\bisc licen[cs]e"),
    ("mpl", "mozilla public", r"mozilla public licen[cs]e"),
    ("epl", "eclipse public", r"eclipse public licen[cs]e"),
    ("cddl", "common development", r"common development and distribution licen[cs]e"),
    ("cpl", "common public", r"common public licen[cs]e"),
    ("eupl", "european union", r"european union public licen[cs]e"),
    ("osl", "open software", r"open software licen[cs]e"),
    ("afl", "academic free", r"academic free licen[cs]e"),
    ("artistic", "artistic licen", r"(?:clarified )?artistic licen[cs]e"),
    ("bsl", "boost software", r"boost software licen[cs]e"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e"),
    ("unlicense", "the unlicense", r"\bthe unlicense\b"),
    ("wtfpl", "want to public", r"do what the f\w*(?: you)? want to public licen[cs]e"),
    ("cc0", "cc0", r"\bcc0(?: public domain dedication| universal)?"),
    ("cc-by-nc-nd", "cc by-nc|cc-by-nc|attribution-noncommercial", r"(?:\bcc(?: |-)by-nc-nd|attribution-noncommercial-noderiv(?:ative)?s)"),
    ("cc-by-nc-sa", "cc by-nc|cc-by-nc|attribution-noncommercial", r"(?:\bcc(?: |-)by-nc-sa|attribution-noncommercial-sharealike)"),
    ("cc-by-nc", "cc by-nc|cc-by-nc|attribution-noncommercial", r"(?:\bcc(?: |-)by-nc|attribution-noncommercial)"),
    ("cc-by-nd", "cc by-nd|cc-by-nd|attribution-noderiv", r"(?:\bcc(?: |-)by-nd|attribution-noderiv(?:ative)?s)"),
    ("cc-by-sa", "cc by-sa|cc-by-sa|attribution-sharealike", r"(?:\bcc(?: |-)by-sa|attribution-sharealike)"),
    ("cc-by", "cc by|cc-by|creative commons attribution", r"(?:\bcc-by\b|\bcc by(?=\W{0,3}(?:\d|licen|$))|creative commons attribution)"),
    ("odbl", "open database", r"open database licen[cs]e"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[cs]e"),
    ("odc-by", "open data commons", r"open data commons attribution licen[cs]e"),
    ("ofl", "open font", r"(?:sil )?open font licen[cs]e"),
    ("fdl", "free documentation", r"free documentation licen[cs]e"),
    ("psf", "python software", r"python software foundation licen[cs]e"),
    ("php", "php licen", r"\bphp licen[cs]e"),
    ("ruby", "ruby licen", r"\bruby licen[cs]e"),
    ("postgresql", "postgresql licen", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl(?: and ssleay)? licen[cs]e"),
    ("curl", "curl licen", r"\bcurl licen[cs]e"),
    ("x11", "x11 licen", r"\bx11 licen[cs]e"),
    ("vim", "vim licen", r"\bvim licen[cs]e"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e"),
    ("sspl", "server side", r"server side public licen[cs]e"),
    ("busl", "business source", r"business source licen[cs]e"),
    ("elastic", "elastic licen", r"elastic licen[cs]e"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e"),
    ("blueoak", "blue oak", r"blue oak model licen[cs]e"),
    ("mulan", "mulan", r"mulan (?:permissive|public) software licen[cs]e"),
    ("cecill", "cecill", r"cecill(?:-[bc])?(?: free software)? licen[cs]e"),
    ("qpl", "q public", r"\bq public licen[cs]e"),
    ("lppl", "latex project", r"latex project public licen[cs]e"),
    ("ipl", "ibm public", r"ibm public licen[cs]e"),
    ("apsl", "apple public", r"apple public source licen[cs]e"),
    ("nasa", "nasa open", r"nasa open source agreement"),
    ("openrail", "openrail|open rail", r"(?:creativeml |bigscience )?open ?rail(?:-m)?(?: licen[cs]e)?"),
)

# Priority (lower wins), confidence, pattern around a name {n}. Each makes one rule of each license.
TEMPLATES = (
    (0, 0.99, r"(?:is |are |be )?(?:dual-?)?licen[cs]ed under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{n}[,;]?(?: \(the \W?licen[cs]e\W?\))?[,;]? (?:v|version )?\d[\d.]*(?: or (?:\(at your option\) )?(?:any )?later)?"),
    (1, 0.95, r"(?:licen[cs]ed|released|distributed|available|provided|published|redistribute it and/or modify it) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{n}(?: \(\w+\))?"),
    (2, 0.9, r"licen[cs]e: ?(?:the )?(?:gnu )?{n}"),
    (3, 0.85, r"(?:gnu )?{n}[,;]? (?:\(\w+\) )?(?:v|version )?\d[\d.]*"),
    (4, 0.75, r"(?:subject to|see|under|governed by) (?:the )?(?:gnu )?{n}"),
    (5, 0.6, r"(?:gnu )?{n}"),
)

# Abbreviations that count after words of a grant only.
GRANTED = tuple((4, 0.75, word, f"under&{word}", rf"(?:licen[cs]ed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?(?:gnu )?{word}\b") for word in ("agpl", "lgpl", "gpl", "mit", "bsd", "isc", "mpl", "epl", "cddl"))
WHOLE = 4096  # characters up to which a rule sees the whole text at once; in longer ones it sees MARGIN words around its keyword
MARGIN = 200  # more words than any match has


def _spaces(pattern: str) -> str:
    """Any white space for each space outside a character class, none too where a question mark follows it."""
    return re.sub(r"\[[^\]]*\]| \??", lambda m: m[0].replace(" ", r"\s") if m[0][0] == "[" else r"\s*" if m[0] == " ?" else r"\s+", pattern)


class Rule(NamedTuple):
    priority: int
    order: int
    label: str
    keyword: str
    pattern: re.Pattern
    confidence: float


class Found(NamedTuple):
    start: int
    end: int
    label: str
    rule: int
    priority: int
    confidence: float


def rules() -> list[Rule]:
    """All rules in order: by priority, then as listed."""
    made = [(p, c, label, word, t.replace("{n}", n)) for p, c, t in TEMPLATES for label, word, n in LICENSES]
    listed = sorted([*SIGNATURES, *made, *GRANTED], key=lambda r: r[0])
    return [Rule(p, k, label, word, re.compile(_spaces(x)), c) for k, (p, c, label, word, x) in enumerate(listed)]


def resolve(found: list[Found]) -> list[Found]:
    """Take detections by priority, longer and earlier ones first; drop each whose interval lies within one taken.

    Of equal intervals the rule that stands first wins. What contains a taken detection stays beside it.
    For each start the furthest end of what is taken from there or before is kept in a prefix tree, so
    that the time is n log n.
    """
    starts = {x: k + 1 for k, x in enumerate(sorted({f.start for f in found}))}
    reach = [-1] * (len(starts) + 1)
    taken: list[Found] = []
    for f in sorted(found, key=lambda f: (f.priority, f.start - f.end, f.start, f.rule)):
        k, furthest = starts[f.start], -1
        while k > 0:
            furthest = max(furthest, reach[k])
            k &= k - 1
        if furthest < f.end:
            taken.append(f)
            k = starts[f.start]
            while k < len(reach):
                reach[k] = max(reach[k], f.end)
                k += k & -k
    return sorted(taken)


class Gate:
    """A rule's keyword: alternatives of parts, each a run of words between any white space."""

    def __init__(self, keyword: str):
        self.ways = [way.split("&") for way in keyword.split("|")]
        self.words = [frozenset(max(part.split(), key=len).encode() for part in way) for way in self.ways]  # a word of each part, which bytes are searched for
        self.patterns = [[re.compile(r"\s+".join(map(re.escape, part.split()))) for part in way] for way in self.ways]

    def places(self, text: str, words: set[bytes]) -> list[int]:
        """Where the first parts of the alternatives stand whose parts the text all holds."""
        out = []
        for need, parts in zip(self.words, self.patterns, strict=True):
            if need <= words and all(p.search(text) for p in parts[1:]):
                out += [m.start() for m in parts[0].finditer(text)]
        return sorted(out)


class Scanner:
    """Applies the rules to texts whose A-Z are lower-cased."""

    def __init__(self):
        self.rules = rules()
        by_word: dict[str, list[Rule]] = {}
        for r in self.rules:
            by_word.setdefault(r.keyword, []).append(r)
        self.gates = [(Gate(w), its) for w, its in by_word.items()]
        self.words = sorted(set().union(*[need for g, _ in self.gates for need in g.words]))
        self.by_rare: dict[bytes, list[tuple[Gate, list[Rule]]]] = {}  # gates by the longest word of each alternative
        for g, its in self.gates:
            for need in g.words:
                self.by_rare.setdefault(max(need, key=lambda w: (len(w), w)), []).append((g, its))

    def held(self, low: bytes, offsets: np.ndarray) -> dict[int, set[bytes]]:
        """The keyword words that each text of a run holds, found over the bytes of all of them."""
        out: dict[int, set[bytes]] = {}
        ends = offsets.tolist()
        for w in self.words:
            at = low.find(w)
            while at >= 0:
                row = bisect.bisect_right(ends, at) - 1
                if at + len(w) <= ends[row + 1]:
                    out.setdefault(row, set()).add(w)
                    at = low.find(w, ends[row + 1])  # on to the next text
                else:
                    at = low.find(w, at + 1)
        return out

    def scan(self, text: str, words: set[bytes] | None = None) -> list[Found]:
        """The detections in a text, of which ``words`` are the keyword words that it holds."""
        if words is None:
            words = self.held(raw := text.encode(), np.array([0, len(raw)])).get(0, set())
        found: list[Found] = []
        starts: list[int] | None = None
        for g, its in {id(x[0]): x for w in words for x in self.by_rare.get(w, ())}.values():
            places = g.places(text, words)
            if not places:
                continue
            spans = [(0, len(text))]
            if len(text) > WHOLE:
                starts = starts or [m.start() for m in re.finditer(r"\S+", text)]
                spans = []
                for p in places:
                    k = bisect.bisect_right(starts, p) - 1
                    low = starts[max(0, k - MARGIN)]
                    high = starts[k + MARGIN] if k + MARGIN < len(starts) else len(text)
                    if spans and low <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], high)
                    else:
                        spans.append((low, high))
            found += [Found(m.start(), m.end(), r.label, r.order, r.priority, r.confidence) for r in its for low, high in spans for m in r.pattern.finditer(text, low, high)]
        return resolve(found)


def base_places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, str]]]:
    """Words of each text, and per base phrase the texts and word numbers at which it starts."""
    starts, ends, first = word_bounds(data, offsets, NOT_ALNUM)
    words = word_hashes(data, starts, ends)
    out = []
    for phrase, label in BASE_PHRASES:
        raw = np.frombuffer(phrase.encode(), np.uint8)
        s, e, _ = word_bounds(raw, np.array([0, len(raw)]))
        asked = word_hashes(raw, s, e)
        at = np.flatnonzero(words[: max(0, len(words) - len(asked) + 1)] == asked[0])
        for k in range(1, len(asked)):
            at = at[words[at + k] == asked[k]]
        text = np.searchsorted(first, at, "right") - 1
        inside = at + len(asked) <= first[text + 1]
        out.append((text[inside], at[inside] - first[text[inside]], label))
    return np.diff(first), out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Detect licenses in whole texts.

    Returns per row: ``id_col``, n_words, base (an array of place and label, one entry for each place of
    a base phrase) and detections (an array of start, end, label, rule, confidence: code points of the
    text, after suppression). Rules see the text with A-Z lower-cased and match across any white space.
    A null text is empty. Null and repeated ids pass through; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = batch.column("text")
            for a, b, data, offsets in text_slices(texts, SHORT_SLICE):
                n, phrases = base_places(data, offsets)
                base: list[list[dict]] = [[] for _ in range(b - a)]
                for where, place, label in phrases:
                    for k, p in zip(where.tolist(), place.tolist(), strict=True):
                        base[k].append({"place": p, "label": label})
                low = LOWER[data].tobytes()
                hits: list[list[dict]] = [[] for _ in range(b - a)]
                for k, words in scanner.held(low, offsets).items():
                    found = scanner.scan(low[offsets[k] : offsets[k + 1]].decode(), words)
                    hits[k] = [{"start": f.start, "end": f.end, "label": f.label, "rule": f.rule, "confidence": f.confidence} for f in found]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), pa.array(base, _BASE), pa.array(hits, _HITS)], names=["doc_id", "n_words", "base", "detections"])

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, base array<struct<place:long,label:string>>, detections array<struct<start:long,end:long,label:string,rule:int,confidence:double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("doc_id", id_col)


_BASE = pa.list_(pa.struct([("place", pa.int64()), ("label", pa.string())]))
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("rule", pa.int32()), ("confidence", pa.float64())]))
