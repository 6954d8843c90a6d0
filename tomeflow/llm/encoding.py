"""Problem 2: text decoded with a wrong character encoding.

Adjacent character pairs are scored by their mutual information over the corpus, counted by
documents. A pair in less than ``min_share`` of the documents counts as unseen, for a wrong decoding
is as regular as a language: its pairs would otherwise vouch for each other. So does, in however
many documents, a pair that a mapping explains as known text decoded wrongly (``damage``). Unseen pairs score
+1 and seen pairs below 0, the lower the stronger they are bound; the maximum-scoring segments of a
text are its improbable runs. Only inside these the inverse mappings are tried: the run is
encoded with the charset that may have been used and decoded with the one that should have been.
A mapping is taken if what it gives is made of pairs that the corpus knows, or is strictly valid
multi-byte text. Runs that hold replacement characters or other debris of lost bytes are affected
but can't be restored beyond what a mapping gives back. Rare and foreign characters alone aren't
evidence: no mapping gives known text from them.

The table of seen pairs is broadcast. Its size is bounded by (mean number of distinct pairs of a
document) / ``min_share``, as every seen pair is in that share of the documents.

Null and empty contents aren't affected. Copies are judged alike. Whole texts are read.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MIN_SHARE, MIN_DOCS = 0.03, 3
MIN_SCORE, GAP = 2.0, 4
PURE, USUAL, LEAST_FORMS = 0.8, 50, 10
KNOWN, LONG_KNOWN, GAIN, VALID = 0.5, 0.35, 0.25, 0.7

# Fixed values: (charset that was used, charset that should have been), by the names of Python's codecs.
MAPPINGS = [
    ("gbk", "utf-8"), ("cp932", "utf-8"), ("cp1252", "utf-8"), ("latin-1", "utf-8"), ("cp1251", "utf-8"), ("mac-roman", "utf-8"), ("koi8-r", "utf-8"), ("cp437", "utf-8"), ("cp850", "utf-8"), ("cp866", "utf-8"), ("big5", "utf-8"), ("cp949", "utf-8"), ("euc-jp", "utf-8"), ("cp1250", "utf-8"), ("cp1253", "utf-8"), ("cp1254", "utf-8"), ("cp874", "utf-8"),
    ("big5", "gbk"), ("cp932", "gbk"), ("cp949", "gbk"), ("euc-jp", "gbk"), ("cp1252", "gbk"), ("latin-1", "gbk"), ("cp1251", "gbk"), ("koi8-r", "gbk"), ("cp437", "gbk"), ("mac-roman", "gbk"),
    ("gbk", "big5"), ("gbk", "cp932"), ("gbk", "euc-jp"), ("big5", "cp932"), ("cp949", "cp932"), ("cp1252", "cp932"), ("latin-1", "cp932"), ("cp1251", "cp932"), ("cp1252", "euc-jp"), ("latin-1", "euc-jp"), ("cp1252", "big5"), ("latin-1", "big5"), ("euc-jp", "cp932"), ("cp932", "euc-jp"), ("gbk", "cp949"),
    ("utf-16-be", "utf-16-le"), ("utf-16-le", "utf-16-be"), ("utf-16-le", "utf-8"), ("utf-16-be", "utf-8"),
    ("mac-roman", "cp1252"), ("cp1252", "mac-roman"), ("cp437", "cp1252"), ("cp1252", "cp437"), ("cp850", "cp1252"), ("cp1252", "cp850"), ("cp1251", "cp1252"), ("cp1252", "cp1251"), ("cp1250", "cp1252"), ("koi8-r", "cp1252"), ("gbk", "cp1252"), ("cp932", "cp1252"), ("big5", "cp1252"), ("cp1253", "cp1252"), ("cp949", "cp1252"), ("cp874", "cp1252"),
]
LOST = "�"
SHIFT = np.uint64(21)


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    return np.where((c >= 48) & (c <= 57), np.uint64(48), c)


def pairs(text: str) -> np.ndarray:
    c = codes(text)
    return (c[:-1] << SHIFT) | c[1:]


ZEROS, DIGIT = str.maketrans("123456789", "0" * 9), re.compile("[1-9]")
#: up to so many characters a look at each pair is cheaper than arrays
FEW_CHARS = 64


class Pairs:
    """The corpus's seen pairs: sorted keys and scores below 0."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.scores = keys[order], scores[order]
        self.texts = {chr(k >> 21) + chr(k & 0x1FFFFF) for k in self.keys.tolist()}
        self.cache: dict = {}

    def score(self, text: str) -> np.ndarray:
        """+1 for each unseen pair, less than 0 for each seen one; pairs with white space or ASCII only are never improbable."""
        c = codes(text)
        p = (c[:-1] << SHIFT) | c[1:]
        if not len(self.keys):
            at, seen = np.zeros(len(p), int), np.zeros(len(p), bool)
        else:
            at = np.minimum(np.searchsorted(self.keys, p), len(self.keys) - 1)
            seen = self.keys[at] == p
        out = np.where(seen, self.scores[at] if len(self.keys) else 0.0, 1.0)
        return np.where((c[:-1] < 128) & (c[1:] < 128), -0.5, out)

    def known(self, text: str) -> float:
        """The share of known pairs among those that aren't ASCII only."""
        if len(text) < 2:
            return 0.0
        if len(text) > FEW_CHARS:
            s = self.score(text)
            c = codes(text)
            wide = (c[:-1] >= 128) | (c[1:] >= 128)
            return float((s[wide] < 0).mean()) if wide.any() else 1.0
        if DIGIT.search(text):
            text = text.translate(ZEROS)
        two = [x for x in map(str.__add__, text, text[1:]) if not x.isascii()]
        return sum(map(self.texts.__contains__, two)) / len(two) if two else 1.0

    def all_seen(self, text: str) -> bool:
        """Whether every pair is a seen one, or ASCII only."""
        if DIGIT.search(text):
            text = text.translate(ZEROS)
        return all(x in self.texts or x.isascii() for x in map(str.__add__, text, text[1:]))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (from, to, score), to excluded; linear time (Ruzzo and Tompa)."""
    if not len(scores):
        return []
    change = np.flatnonzero(np.diff(np.sign(scores))) + 1
    starts = np.concatenate([[0], change])
    stops = np.concatenate([change, [len(scores)]])
    sums = np.add.reduceat(scores, starts)
    found: list[list[float]] = []  # from, to, sum before, sum after
    total = 0.0
    for a, b, s in zip(starts.tolist(), stops.tolist(), sums.tolist()):
        before, total = total, total + s
        if s <= 0:
            continue
        new = [a, b, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j -= 1
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(int(a), int(b), y - x) for a, b, x, y in found]


#: codecs of more than one byte a character; all others map undefined bytes to the control of the same number
WIDE = {"gbk": "gb18030", "big5": "cp950", "cp932": "cp932", "cp949": "cp949", "euc-jp": "euc-jp"}
CONTROLS = [*map(chr, range(0x80, 0xA1)), "\xad"]
#: what is one byte in cp932 besides ASCII: half-width katakana and the bytes that are no character
ONE_BYTE = {*map(chr, range(0xFF61, 0xFFA0)), "\x80", "\xa0", "\uf8f1", "\uf8f2", "\uf8f3"}
ONE_BYTE_RUN = re.compile("[" + "".join(sorted(ONE_BYTE)) + "]")
WIDE_CHAR, ODD_CHAR = re.compile("[\u2e80-\U0010ffff]"), re.compile("[\x80-\u2e7f]")
_missed = 0


def _lost_byte(error: UnicodeError) -> tuple[bytes, int]:
    """For what a charset can't have given: lost bytes become 0xFF, controls their own byte, all else is counted."""
    global _missed
    out = bytearray()
    for ch in error.object[error.start : error.end]:
        raw = b"\xff"
        if ch == LOST:
            pass
        elif ch == "€" and error.encoding.startswith("gb"):
            raw = b"\x80"
        elif error.encoding in WIDE.values() or error.encoding in WIDE or error.encoding.startswith("euc"):
            other = ch.encode(WIDE.get(error.encoding, error.encoding), "ignore")
            raw, _missed = (other, _missed) if 0 < len(other) <= 2 else (raw, _missed + 1)
        elif "\x80" <= ch <= "\xa0" or ch == "\xad":
            raw = bytes([ord(ch)])
        else:
            _missed += 1
        out += raw
    return bytes(out), error.end


codecs.register_error("lost-byte", _lost_byte)


@lru_cache(maxsize=None)
def _byte_table(codec: str) -> tuple:
    """(the encoding map, the character of byte 0xFF, what stands for the controls it lacks) of a charset of one byte."""
    table = [bytes([b]).decode(codec, "ignore") or chr(b) for b in range(256)]
    return codecs.charmap_build("".join(table)), table[255], {c: table[ord(c)] for c in CONTROLS if c not in table}


codecs.register_error("all-lost", lambda error: (b"\xff" * (error.end - error.start), error.end))
CONTROL = re.compile("[\x80-\xa0\xad]")


def _encode(text: str, codec: str) -> bytes | None:
    """The bytes that were read with ``codec``; a lost byte becomes 0xFF. None if the text can't come from it."""
    global _missed
    if codec.startswith("utf-16"):
        return text.replace(LOST, "\uffff").encode(codec, "surrogatepass")
    if codec not in WIDE:
        table, last, controls = _byte_table(codec)
        if LOST in text:
            text = text.replace(LOST, last)
        for c in set(CONTROL.findall(text)):
            text = text.replace(c, controls.get(c, c))
        raw = codecs.charmap_encode(text, "ignore", table)[0]
        missed = len(text) - len(raw)
        if missed > 0.1 * len(text):
            return None
        return codecs.charmap_encode(text, "all-lost", table)[0] if missed else raw
    # a quick look at how much the charset has, before its gaps are filled one by one
    raw = text.encode(codec, "ignore")
    if len(raw) < 1.6 * len(text):
        single = len(text.encode("ascii", "ignore")) + (len(ONE_BYTE_RUN.findall(text)) if codec == "cp932" else 0)
        if len(raw) + 2 * text.count(LOST) < 0.8 * (2 * (len(text) - single) + single):
            return None
    try:
        return text.encode(codec)
    except UnicodeError:
        pass
    _missed = 0
    raw = text.encode(codec, "lost-byte")
    return None if _missed > 0.1 * len(text) else raw


def inverse(run: str, used: str, right: str, raw: bytes | None = None) -> str | None:
    """``run`` read again with the right charset, U+FFFD where bytes are lost. Text encoded more than once is undone as often.

    raw: the run's bytes in ``used``, where they are known already.
    """
    again = 0
    while True:
        if LOST in run and right not in MULTI:  # a lost byte is no character of the right charset
            parts = [_encode(x, used) for x in run.split(LOST)]
            return None if None in parts or not any(parts) else LOST.join(x.decode(right, "replace") for x in parts)
        if again or raw is None:
            raw = _encode(run, used)
        if not raw:
            return None if not again else run
        if right.startswith("utf-16") and len(raw) % 2:
            raw = raw[:-1]
        text = raw.decode("gb18030" if right == "gbk" else right, "replace")
        if again and (LOST in text or len(text) >= len(run)):
            return run
        if text == run:
            return None if not again else run
        run = text
        again += 1
        if right != "utf-8" or used in WIDE:
            return run


def _plausible(text: str) -> bool:
    """Whether at most one in twenty characters is a control, unassigned, private or half of a pair."""
    if text.isprintable():
        return True
    for space in "\n\r\t\u3000\xa0":
        text = text.replace(space, " ")
    if text.isprintable():
        return True
    bad = sum(text.count(c) for c in set(text) if unicodedata.category(c) in ("Cc", "Cn", "Co", "Cs"))
    return bad * 20 <= len(text)


def accepted(run: str, text: str | None, left: str, right_side: str, before: float, mapping: tuple[str, str], seen: Pairs, settled: bool) -> float:
    """How good ``text`` is as a reading of ``run``; 0 if it isn't taken. settled: the document has this mapping already."""
    if not text:
        return 0.0
    valid = 1 - text.count(LOST) / len(text)
    clean = text.strip(LOST)
    if valid < (VALID if not settled else 0.5) or not clean or not _plausible(clean.replace(LOST, "")):
        return 0.0
    after = seen.known(left + clean + right_side)
    used, right = mapping
    known = KNOWN if len(clean) < 12 or valid < 0.95 else LONG_KNOWN
    sure = used in ("cp1252", "latin-1") or after >= 0.25
    strict = sure and right == "utf-8" and valid == 1 and used not in WIDE and len(clean) < len(run) and not clean.isascii() and all(c.isalnum() or unicodedata.category(c)[0] in "MPSZ" or c in "\r\n\t" for c in clean)
    enough = len(clean) >= 4 or right == "utf-8" and valid == 1
    if strict or (after >= max(known, before + GAIN) and enough) or settled and after >= before + 0.1:
        return 0.01 + after * valid + (0.5 if strict else 0.0)
    return 0.0


NARROW = {used for used, _ in MAPPINGS} - {*WIDE, "utf-16-le", "utf-16-be"}
MULTI = {*WIDE, "utf-8", "utf-16-le", "utf-16-be"}
_readings: dict[str, list] = {}


BY_USED: dict[str, list[tuple[int, str]]] = {}
for _i, (_used, _right) in enumerate(MAPPINGS):
    BY_USED.setdefault(_used, []).append((_i, _right))


def readings(run: str) -> list[tuple[str, tuple[str, str]]]:
    """All readings of a run by the mappings that give mostly valid text; kept for short runs, which recur."""
    found = _readings.get(run)
    if found is None:
        order = []
        wide = len(WIDE_CHAR.findall(run))
        odd = wide + len(ODD_CHAR.findall(run))
        for used, rights in BY_USED.items():
            # a charset of one byte has no wide characters, and text read with another one is full of them
            if wide > 0.1 * len(run) if used in NARROW else wide < 0.2 * odd:
                continue
            raw = _encode(run, used)
            if raw is None:  # then one of its parts between lost bytes can't come from it either
                continue
            for i, right in rights:
                text = inverse(run, used, right, raw)
                if text and text.count(LOST) <= (1 - VALID) * len(text) and _plausible(text.replace(LOST, "")):
                    order.append((i, text))
        found = [(text, MAPPINGS[i]) for i, text in sorted(order)]
        if len(run) < 64:
            if len(_readings) > 200_000:
                _readings.clear()
            _readings[run] = found
    return found


def restore(run: str, left: str, right_side: str, seen: Pairs, settled: list | None = None, trimmed: bool = False) -> tuple[str, tuple[str, str]] | None:
    """The best reading of an improbable run with its mapping, or None. left, right_side: a character of context on either side."""
    key = (left, run, right_side, trimmed)
    if not settled and key in seen.cache:
        return seen.cache[key]
    options = [(inverse(run, *m), m) for m in settled] if settled else readings(run)
    if trimmed:  # between charsets of one byte, where a run begins and ends is certain
        options = [o for o in options if o[1][1] in MULTI]
    if not options and (settled or len(run) >= 64):
        return None
    before = seen.known(left + run + right_side) if options else 0.0
    best, score = None, 0.0
    for text, m in options:
        s = accepted(run, text, left, right_side, before, m, seen, bool(settled))
        if s > score:
            best, score = (text, m), s
            if s > 0.75 and len(text) >= 12:
                break  # no other reading of as much text can be known as well
    if not settled and len(run) < 64:
        if len(seen.cache) > 200_000:
            seen.cache.clear()
        seen.cache[key] = best
    return best


def improbable_runs(text: str, seen: Pairs) -> list[tuple[int, int]]:
    """(from, to) of the maximum-scoring segments, joined where little lies between them, without ASCII at their ends."""
    runs: list[list[int]] = []
    for a, b, s in segments(seen.score(text)):
        if runs and a - runs[-1][1] <= GAP and "\n" not in text[runs[-1][1] - 1 : a + 1]:
            runs[-1][1] = b + 1
        elif s >= MIN_SCORE:
            runs.append([a, b + 1])
    out, at = [], 0
    for a, b in runs:
        a = max(a, at)
        while a < b and ord(text[a]) < 128:
            a += 1
        while b > a and ord(text[b - 1]) < 128:
            b -= 1
        if b > a:
            out.append((a, b))
            at = b
    return out


REACH = 8


def widened(text: str, a: int, b: int, at: int, mapping: tuple[str, str]) -> tuple[int, int, str]:
    """A run that a mapping explains, with the neighbours that belong to it: those that leave the fewest lost bytes."""
    best = (a, b, inverse(text[a:b], *mapping) or text[a:b])
    lost = best[2].count(LOST)
    for x in range(a - 1, max(at, a - REACH) - 1, -1):
        if ord(text[x]) < 128:
            break
        new = inverse(text[x:b], *mapping)
        if new is not None and (new.count(LOST) < lost or new.count(LOST) == lost and len(new) < len(best[2]) + (a - x) and "utf-8" == mapping[1] and mapping[0] not in WIDE):
            best, lost = (x, b, new), new.count(LOST)
    a = best[0]
    for y in range(b + 1, min(len(text), b + REACH) + 1):
        if ord(text[y - 1]) < 128:
            break
        new = inverse(text[a:y], *mapping)
        if new is not None and new.count(LOST) < lost:
            best, lost = (a, y, new), new.count(LOST)
    return best


FEW = 6
PIECE = re.compile(r"[^\x00-\x7f\ufffd](?:[^\n\ufffd]*[^\x00-\x7f\ufffd])?")


def short_wide(text: str, a: int, b: int) -> bool:
    return b - a < FEW and WIDE_CHAR.search(text, a, b) is not None


def whole_pieces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """The parts of a run between line ends and lost bytes, without ASCII at their ends."""
    return [(a + m.start(), a + m.end()) for m in PIECE.finditer(text[a:b])]


@lru_cache(maxsize=100_000)
def strict_readings(run: str) -> tuple[tuple[str, tuple[str, str]], ...]:
    """The readings of a few wide characters without a lost byte."""
    order = []
    for used, rights in BY_USED.items():
        if used not in NARROW:
            try:
                raw = run.encode(WIDE.get(used, used))
            except UnicodeError:
                continue
            for i, right in rights:
                try:
                    new = raw.decode("gb18030" if right == "gbk" else right)
                except UnicodeError:
                    continue
                if new != run and _plausible(new):
                    order.append((i, new))
    return tuple((new, MAPPINGS[i]) for i, new in sorted(order))


def isolated(text: str, runs: list[tuple[int, int]], seen: Pairs) -> dict[tuple[int, int], tuple[str, tuple[str, str]]]:
    """Readings of short runs of wide characters, by run.

    One such run may be a name. Among Latin letters, all of a document's are judged together: one
    mapping must turn at least half of them, and two, into known letters. Elsewhere, a run is taken
    alone if no more than a little of it is known, and all pairs of what it gives are: at least two,
    or one in UTF-8.
    """
    latin: dict[tuple[str, str], list] = {}
    out, beside = {}, 0
    for a, b in runs:
        near = [c for c in (text[a - 1 : a], text[b : b + 1]) if c]
        among = any(c.isalpha() and c < "\u2e80" for c in near)
        beside += among
        found = strict_readings(text[a:b])
        before = seen.known(text[a - 1 : a] + text[a:b] + text[b : b + 1]) if found else 0.0
        best = 0.0
        for new, m in found:
            if among and m[1] not in MULTI and max(new) < "\u2e80" and any(c.isalpha() for c in new):
                share = seen.known(text[a - 1 : a] + new + text[b : b + 1])
                if share >= max(KNOWN, before + GAIN):
                    latin.setdefault(m, []).append((share, (a, b), new))
            elif not among and m[1] in MULTI:
                n = len(new) - 1
                sure = n >= (1 if m[1] == "utf-8" else 2) and before < 0.25 and not new.isascii() and seen.all_seen(new)
                if sure and n > best:
                    best, out[(a, b)] = n, (new, m)
    if latin:
        m = max(latin, key=lambda x: (len(latin[x]), sum(s for s, *_ in latin[x])))
        if len(latin[m]) >= max(2, beside / 2):
            out |= {at: (new, m) for _, at, new in latin[m]}
    return out


def examine(text: str | None, seen: Pairs) -> tuple[str | None, int, int]:
    """(text with its runs restored where possible, runs restored, whether damage stays)."""
    if not text or text.isascii():
        return text, 0, 0
    out, at, restored = [], 0, 0
    settled: list[tuple[str, str]] = []
    todo = [y for x in improbable_runs(text, seen) for y in (whole_pieces(text, *x) if short_wide(text, *x) else [x])][::-1]
    few = isolated(text, [x for x in todo[::-1] if short_wide(text, *x)], seen)
    while todo:
        a, b = todo.pop()
        a = max(a, at)
        if a >= b:
            continue
        if short_wide(text, a, b):
            if (a, b) in few:
                new, mapping = few[a, b]
                if mapping not in settled:
                    settled.append(mapping)
                out += [text[at:a], new]
                at = b
                restored += 1
            continue
        spans = [(a, b)]
        if b - a < 12 and max(text[a:b]) < "\u2e80":  # a pair reaches a character beyond a short run, or into it
            spans += [(x, y) for x in (a - 1, a, a + 1) for y in (b - 1, b, b + 1) if (x, y) != (a, b) and at <= x < y <= len(text)]
        found = x = y = None
        for known in (settled, None) if settled else (None,):
            for x, y in spans:
                found = restore(text[x:y], text[x - 1 : x], text[y : y + 1], seen, known, (x, y) != (a, b))
                if found:
                    break
            if found:
                break
        if found:
            if found[1] not in settled:
                settled.append(found[1])
            x, y, new = widened(text, x, y, at, found[1])
            out += [text[at:x], new]
            at = y
            restored += 1
        elif "\n" in text[a:b]:  # a garbled paragraph may have drawn its neighbours in
            lines, end = [], a
            for line in text[a:b].split("\n"):
                lines.append((end, end + len(line)))
                end += len(line) + 1
            todo += [x for x in lines[::-1] if x[0] < x[1]]
    out.append(text[at:])
    fixed = "".join(out)
    return fixed, restored, int(LOST in fixed or "锟斤拷" in fixed)


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])]


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): documents by pair, by character, and in all; summed over each batch."""
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t and len(t) > 1]
        if not texts:
            continue
        coded = [codes(t) for t in texts]
        p, n = np.unique(np.concatenate([_distinct((c[:-1] << SHIFT) | c[1:]) for c in coded]), return_counts=True)
        c, m = np.unique(np.concatenate([_distinct(c) for c in coded]), return_counts=True)
        kind = np.concatenate([np.zeros(len(p), np.int32), np.ones(len(c), np.int32), np.full(1, 2, np.int32)])
        key = np.concatenate([p, c, np.zeros(1, np.uint64)]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(np.concatenate([n, m, [len(texts)]]).astype(np.int64))], names=["kind", "key", "n"])


def _fragment(raw: bytes, chars: set[bytes], heads: set[bytes], tails: set[bytes], inner: set[bytes]) -> bool:
    """Whether bytes are a piece of text made of ``chars``: an end of one, whole ones, a beginning of one."""
    if raw in inner:
        return True
    reach = {0} | {i for i in range(1, min(4, len(raw)) + 1) if raw[:i] in tails}
    for i in range(len(raw)):
        if i in reach:
            if raw[i:] in heads:
                return True
            reach |= {j for j in range(i + 1, min(i + 4, len(raw)) + 1) if raw[i:j] in chars}
    return len(raw) in reach


def _pieces(chars: list[str], right: str) -> tuple[set[bytes], set[bytes], set[bytes], set[bytes]]:
    """(whole, beginnings, ends, what is inside) of characters in a charset."""
    whole = {raw for c in chars if (raw := c.encode(right, "ignore"))}
    heads, tails = {c[:i] for c in whole for i in range(1, len(c))}, {c[i:] for c in whole for i in range(1, len(c))}
    return whole, heads, tails, {c[i:j] for c in whole for i in range(1, len(c)) for j in range(i + 1, len(c))}


def damage(chars: np.ndarray, char_n: np.ndarray, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Which seen pairs are known text decoded wrongly, however common that is.

    A pair is explained by a mapping if the mapping turns it into a piece of UTF-8 of seen characters
    (or of two-byte text, if half of its ``USUAL`` characters are seen as such pairs) or, between
    other charsets, into seen pairs in more documents. One explained pair may be chance:
    ``PURE`` of the seen pairs of one of its characters must be explained by the same mapping.
    """
    a, b = (keys >> SHIFT).tolist(), (keys & np.uint64((1 << 21) - 1)).tolist()
    odd = [i for i in range(len(a)) if (a[i] >= 128 or b[i] >= 128) and not (0xD800 <= a[i] < 0xE000 or 0xD800 <= b[i] < 0xE000) and LOST not in (chr(a[i]), chr(b[i]))]
    text = {i: chr(a[i]) + chr(b[i]) for i in odd}
    count = dict(zip(keys.tolist(), n.tolist()))
    usual = [chr(c) for c in chars[np.argsort(-char_n, kind="stable")].tolist() if not 0xD800 <= c < 0xE000]
    pieces = {right: _pieces(usual, right) for right in ("utf-8", *WIDE)}
    common = [c for c in usual if c >= "\u2e80"][:USUAL]
    of: dict[str, set[int]] = {}
    for i, t in text.items():
        for c in t:
            if c >= "\x80":
                of.setdefault(c, set()).add(i)
    out = np.zeros(len(keys), bool)
    for used, right in MAPPINGS:
        coded = {c: _byte_or_none(c, used) for c in {x for t in text.values() for x in t}}
        explained = set()
        # two bytes of one each are too easily an end and a beginning, unless the usual characters occur in this form
        forms = [raw.decode(used) for c in common if used in NARROW and right in WIDE and len(raw := c.encode(right, "ignore")) == 2 and len(raw.decode(used, "ignore")) == 2]
        active = 2 * sum(int(pairs(f)[0]) in count for f in forms) >= max(2 * LEAST_FORMS, len(forms))
        for i, t in text.items():
            x, y = coded[t[0]], coded[t[1]]
            if x is None or y is None:
                continue
            if right == "utf-8" or active:
                if _fragment(x + y, *pieces[right]):
                    explained.add(i)
                continue
            try:
                clean = (x + y).decode("gb18030" if right == "gbk" else right)
            except UnicodeError:
                continue
            if clean != t and len(clean) > 1 and not clean.isascii() and min(count.get(k, 0) for k in pairs(clean).tolist()) > n[i]:
                explained.add(i)
        pure = {c for c, at in of.items() if len(at & explained) >= PURE * len(at)}
        out[[i for i in explained if text[i][0] in pure or text[i][1] in pure]] = True
    return out


def _byte_or_none(ch: str, used: str) -> bytes | None:
    try:
        return ch.encode(WIDE.get(used, used))
    except UnicodeError:
        return bytes([ord(ch)]) if used in NARROW and "\x80" <= ch <= "\xa0" else None


def scored_pairs(kind: np.ndarray, key: np.ndarray, n: np.ndarray, total: int) -> Pairs:
    """The table of seen pairs out of the documents' counts by character (kind 1) and pair (kind 0), without damage."""
    chars, char_n = key[kind == 1], n[kind == 1]
    order = np.argsort(chars)
    chars, char_n = chars[order], char_n[order]
    keys, pair_n = key[kind == 0].astype(np.uint64), n[kind == 0]
    if not len(keys):
        return Pairs(np.zeros(0, np.uint64), np.zeros(0))
    a, b = (keys >> SHIFT).astype(np.int64), (keys & np.uint64((1 << 21) - 1)).astype(np.int64)
    of = lambda x: char_n[np.searchsorted(chars, x)]  # noqa: E731  a seen pair's characters are in as many documents
    information = np.log(pair_n * float(total) / (of(a) * of(b).astype(float)))
    kept = ~damage(chars, char_n, keys, pair_n)
    return Pairs(keys[kept], -np.clip(1.0 + information, 0.5, 3.0)[kept])


def seen_pairs(texts: DataFrame, min_share: float = MIN_SHARE, min_docs: int = MIN_DOCS) -> Pairs:
    """The pairs in at least ``min_share`` of the documents, scored by mutual information. texts: one string column."""
    counts = texts.mapInArrow(_pair_counts, "kind int, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    try:
        total = next((r["n"] for r in counts.where("kind = 2").collect()), 0)
        least = max(min_docs, min_share * total)
        rows = counts.where((F.col("kind") < 2) & (F.col("n") >= least)).toArrow()
    finally:
        counts.unpersist()
    return scored_pairs(*(rows.column(i).to_numpy() for i in range(3)), total)


def garbled(df: DataFrame, id_col: str, text_col: str, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, content, restored, damaged) of the affected rows: the text as far as it can be restored."""
    seen = seen_pairs(df.select(text_col), min_share)
    shared = df.sparkSession.sparkContext.broadcast((seen.keys, seen.scores))
    kind = df.schema[id_col].dataType.simpleString()

    def look(batches: Iterator) -> Iterator:
        import pandas as pd

        known = Pairs(*shared.value)
        for pdf in batches:
            rows = [(i, *examine(t, known)) for i, t in zip(pdf.iloc[:, 0], pdf.iloc[:, 1])]
            yield pd.DataFrame([r for r in rows if r[2] or r[3]], columns=["id", "content", "restored", "damaged"])

    return df.select(id_col, text_col).mapInPandas(look, f"id {kind}, content string, restored int, damaged int").withColumnRenamed("id", id_col)


def p2_found(spark, sf_dir: str) -> DataFrame:
    return garbled(spark.read.parquet(f"{sf_dir}/raw_documents.parquet"), "raw_id", "content").select("raw_id")


def p2_restored(spark, sf_dir: str) -> DataFrame:
    return garbled(spark.read.parquet(f"{sf_dir}/raw_documents.parquet"), "raw_id", "content").select("raw_id", "content", "restored", (F.col("damaged") == 0).alias("complete"))
