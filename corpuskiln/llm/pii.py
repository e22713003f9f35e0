"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) are matched leftmost and without overlap for each kind; a match that fails its
test is dropped. The random field adds spans of kind ``secret`` (keys, tokens, passwords) that no pattern can name. It
is trained on the driver from the small labelled table below, and decoded by Viterbi in numpy batches over all words of
every text. Words whose label cannot be anything but plain on the best path, whatever stands around them, are told by a
bound on the weights; they cut a text into short sequences that are decoded together, with the same result.

Offsets count code points, the end is exclusive. Cases: a null or empty text has no spans; long texts are searched whole;
repeated rows give equal results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .common import batch, documents, records

KINDS = ("email", "ip", "card", "phone")
SECRET = "secret"
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")  # a match can begin only where a run of digits begins
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches that pass their tests, ordered."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > last and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at) if lo < at else None
        if m:
            out.append((lo, 0, m.end()))
            last = m.end()
        at = text.find("@", m.end() if m else at + 1)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


# ---- the random field ----------------------------------------------------------------------------------------------

LABELS = ("O", "KEY", "SEC")  # plain, a word that announces a secret, the secret itself
FEATURES = 1 << 14
QUARTER = FEATURES // 4  # numbers for each place: own word, the word before, the one before that, the word after
_STRIP = "\"'`.,;:!?#*$%&()[]{}<>|"

#: The labelled table: texts with the secret in [[ ]] and announcing words in (( )).
TRAINING = [
    '((token)) ((=)) [["04dbebab91ab85687d33eeaaf9ac699e1188f962"]] was found in the file',
    'set ((token)) ((=)) [["9b0b3c6a43eb78aa99cbd7049c572391"]] and go on',
    '((TOKEN)) ((=)) [["9233A8ECF7C5B09FE5949719B6B82BC4"]]!! SO IT WENT',
    'in | ((token)) ((=)) [["8ef5f278dec875d2b96fdf291615913d21aee5ca"]] | und',
    '((api_key)) ((=)) [["sk3fa9d01bc77e4410a2b6f9c0de112233"]] please rotate',
    '((api_key)): [[a81bc81bdead4e5dabff90865d1e13b1]] in the config',
    '((password)) ((=)) [["hunter2hunter22"]] do not share',
    '((password)): [[pa55w0rdpa55]] for the box',
    '((secret)) ((=)) [["c0ffee00c0ffee00c0ffee00c0ffee00"]]### end',
    '((key)) ((=)) [["00ff17aa92bc4e6d8f0011223344aabb"]]%%% more',
    "((secret)) ((=)) [['77d1a9b2c3e4f50617283940abcdef12']] there",
    '((access_token)) ((=)) [["1f2e3d4c5b6a79880f1e2d3c4b5a6978"]]. Next',
    'the ((password)) [[winter9storm4pass]] works for the old box',
    'my ((password)) is [[tr0ub4dor3horse]] so keep it',
    '((bearer)) [[5c1f0e9a7b3d42886d0e1f2a3b4c5d6e]] was in the log',
    'the ((token)) [[e91d7a60c2b54f38a7d6e5c4b3a29180f7e6d5c4]] leaked last week',
    'a ((secret)) [[q8z7x6c5v4b3n2m1]] was posted',
    'use ((key)) [[AKz93kd82jdk3l20fKq1]] to log in',
    'they sent ((pwd)) [[blue42river17]] by mail',
    '((auth)) [[d41d8cd98f00b204e9800998ecf8427e]] expired',
    'new ((credential)) [[9f86d081884c7d659a2feaa0c55ad015]] for all of it',
    'and the ((api_key)) [[b7e23ec29af22b0b4e41da31e868d572]] too',
    'write ((passwd)) [[gh7kl2mn9pq4]] down',
    'it had [[f3a94be1c07d5826e4b1909d7c35fa62]] in the middle',
    'between lines [[7d793037a0760186574b0282f2f435e7c1a2b3d4]] stood alone',
    'Licensed under the Apache License, Version 2.0. and more',
    'the GNU General Public License, version 3. applies',
    'call +1 (555) 010-0199 or write to ann.34@mail7.example.com today',
    'from 10.20.30.40 to 192.168.1.7 at noon',
    'paid with 4111111111111111 and 5500005555555559 once',
    'the year 1999 and 2004 were = good',
    'a = b and x = 12 then y = "word" holds',
    'he said "yes" and "no" 3 times',
    'title = "The long night of the north" by them',
    'at 10:30 we met: then left at 11:45',
    'order 12345678 has 3 items: pens, ink',
    'CC BY-NC 4.0. is the licence',
    'section 4.2.1 of part 7',
    'note: the word token is = to nothing here',
    'the key to the house is 2 inches',
    'row | 17 | 4.5 | value | 33',
    'name = "anna" and city = "lyon" here',
    '+1 (974) 555-3436 thatenon it of that',
    'a secret place near the river that nobody knew',
    'his password was long and he forgot it again',
    'the bearer of good news came late that night',
    'an auth server and a credential store were down',
    'the song came as mp3 in 2nd grade of the 21st century',
    'flight LH1234 to gate B22 left at 9am with room2 open',
    'model X200 and type A4 paper cost 15eur each',
    'see https://www.example.org/page1/item2 for part2 of it',
    'a dead beef face added decade facade cafe bed',
    'und es waren 27 Tage im Jahr2000 mit vielen langen Woertern',
    'supercalifragilistic antidisestablishmentarianism words are long',
    'the file report2024final.txt and photo_12.jpg were kept',
    'card 4111 1111 1111 1111 and phone +33 1 23 45 67 89 too',
]


def _labelled(line: str) -> tuple[list[str], np.ndarray]:
    words, labels = [], []
    for raw in line.split():
        label = 1 if raw.startswith("((") else 2 if raw.startswith("[[") else 0
        words.append(re.sub(r"\(\((.*?)\)\)|\[\[(.*?)\]\]", lambda m: m[1] or m[2], raw) if label else raw)
        labels.append(label)
    return words, np.array(labels)


def _kinds() -> np.ndarray:
    """Kind of each byte: A, a and 0 for letters and digits, itself for other ASCII; what is beyond ASCII counts as a."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91], out[97:123], out[48:58], out[128:] = 65, 97, 48, 97
    return out


_KIND = _kinds()
_EDGES = np.zeros(256, dtype=bool)
_EDGES[[ord(c) for c in _STRIP]] = True
_HEX = np.zeros(256, dtype=bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True


def _lexicon() -> frozenset[str]:
    """Words of the table that announce a secret, or occur twice: those the field knows by their letters."""
    seen = Counter()
    for words, labels in map(_labelled, TRAINING):
        for w, y in zip(words, labels.tolist(), strict=True):
            seen[w.strip(_STRIP).lower()] += 2 if y == 1 else 1
    return frozenset(w for w, n in seen.items() if n > 1 and w and not any("0" <= c <= "9" for c in w))


LEXICON = _lexicon()


@lru_cache(maxsize=100_000)
def _word_features(word: str) -> tuple[int, ...]:
    """Hashed feature numbers of a word (without place): its shape (runs of characters of one kind), parts of the shape, and
    its letters where the lexicon has them.

    Only the runs, the number of letters and digits, whether all are hexadecimal, and the word in the lexicon count."""
    runs = re.sub(r"(.)\1+", r"\1", "".join(chr(_KIND[min(ord(c), 128)]) for c in word))
    bare = runs.strip(_STRIP)
    size = sum(_KIND[min(ord(c), 128)] in (48, 65, 97) for c in word)
    hexa = size > 0 and all(ord(c) < 128 and _HEX[ord(c)] for c in word if _KIND[min(ord(c), 128)] in (48, 65, 97))
    mix = ("0" in runs) + 2 * ("a" in runs or "A" in runs)
    turns = len(re.findall(r"0(?=[^0])|[^0](?=0)", bare))
    core = word.strip(_STRIP).translate(_LOWER)
    parts = [
        ("shape", bare if len(bare) <= 6 else "mixed", mix), ("size", min(size // 4, 8), mix), ("turns", min(turns, 6), min(size // 8, 4), any(c not in "Aa0" for c in bare)), ("hexa", hexa and mix == 3, min(size // 8, 4)),
        ("quote", word[:1] in "\"'`", mix), ("mark", runs if len(runs) < 3 and not mix else "", word.endswith(":")), ("letters", core if core in LEXICON else ""),
    ]
    return tuple(int.from_bytes(hashlib.blake2b(repr(p).encode(), digest_size=4).digest(), "little") % (QUARTER - 1) for p in parts)


_LOWER = {c: c + 32 for c in range(65, 91)}


def word_kinds(data: np.ndarray, w: T.Words) -> np.ndarray:
    """A hash of all that ``_word_features`` looks at, for each word of a slice."""
    kind = _KIND[data]
    alnum = (kind == 48) | (kind == 65) | (kind == 97)
    new = np.append(True, kind[1:] != kind[:-1])
    new[w.start] = True
    at = np.flatnonzero(new)
    runs = T.range_hashes(kind[at], np.searchsorted(at, w.start), np.searchsorted(at, w.end))

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(mask))
        return total[w.end] - total[w.start]

    size = count(alnum & ((data & 0xC0) != 0x80))
    hexa = count(alnum & ~_HEX[data]) == 0
    place = np.arange(len(data))
    first = np.minimum.accumulate(np.where(_EDGES[data], len(data), place)[::-1])[::-1]
    last = np.maximum.accumulate(np.where(_EDGES[data], -1, place))
    lo = np.minimum(first[w.start], w.end)
    hi = np.maximum(last[w.end - 1] + 1, lo)
    names = np.array([n.encode() for n in sorted(LEXICON)], dtype=object)
    off = np.append(0, np.cumsum([len(n) for n in names]))
    known = T.range_hashes(np.frombuffer(b"".join(names), dtype=np.uint8), off[:-1], off[1:])
    letters = T.range_hashes(T.lower_ascii(data), lo, hi)
    letters = np.where(np.isin(letters, known), letters, np.uint64(0))
    return T.mix64(T.mix64(runs + (size * 2 + hexa).astype(np.uint64)) + letters)


_EDGE = (QUARTER - 1,) * 7  # beyond a text's ends


def _features(words: list[str]) -> np.ndarray:
    """Feature numbers (words x 28): own, those of the two words before and of the word after."""
    own = np.array([_word_features(w) for w in words], dtype=np.int64).reshape(len(words), 7)
    edge = np.array([_EDGE, _EDGE], dtype=np.int64)
    pad = np.concatenate([edge, own, edge[:1]])
    return np.concatenate([own, pad[1 : 1 + len(own)] + QUARTER, pad[: len(own)] + 2 * QUARTER, pad[3 : 3 + len(own)] + 3 * QUARTER], axis=1)


@lru_cache(maxsize=1)
def train(steps: int = 150, rate: float = 0.5, decay: float = 3e-3) -> tuple[np.ndarray, np.ndarray]:
    """Emission (features x labels) and transition weights by gradient ascent on the log likelihood of the whole table."""
    data = [(_features(w), y) for w, y in map(_labelled, TRAINING)]
    k, longest = len(LABELS), max(len(y) for _, y in data)
    size = np.array([len(y) for _, y in data])
    x = np.zeros((len(data), longest, 28), dtype=np.int64)
    live = np.arange(longest) < size[:, None]
    right = np.zeros((len(data), longest, k))
    for i, (f, y) in enumerate(data):
        x[i, : len(y)] = f
        right[i, np.arange(len(y)), y] = 1
    emit, move = np.zeros((FEATURES, k)), np.zeros((k, k))
    ge, gm = np.full_like(emit, 1e-6), np.full_like(move, 1e-6)
    for _ in range(steps):
        u = emit[x].sum(2)
        fwd, bwd = np.zeros_like(u), np.zeros_like(u)
        fwd[:, 0] = u[:, 0]
        for t in range(1, longest):
            fwd[:, t] = np.where(live[:, t, None], u[:, t] + np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, axis=1), fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            bwd[:, t] = np.where(live[:, t + 1, None], np.logaddexp.reduce(move + (u[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(fwd[:, -1], axis=1)
        g = np.where(live[:, :, None], right - np.exp(fwd + bwd - z[:, None, None]), 0)
        de, dm = -decay * emit, -decay * move
        np.add.at(de, x[live].ravel(), np.repeat(g[live], 28, axis=0))
        for t in range(1, longest):
            both = np.exp(fwd[:, t - 1, :, None] + move + (u[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
            dm += ((right[:, t - 1, :, None] * right[:, t, None, :]) - both)[live[:, t]].sum(0)
        ge += de * de
        gm += dm * dm
        emit += rate * de / np.sqrt(ge)
        move += rate * dm / np.sqrt(gm)
    return emit, move


def viterbi(unary: np.ndarray, size: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of a batch of sequences (sequences x longest x labels), all advancing together."""
    b, n, k = unary.shape
    back = np.zeros((b, n, k), dtype=np.int8)
    score = unary[:, 0].copy()
    for t in range(1, n):
        cand = score[:, :, None] + move[None]
        back[:, t] = cand.argmax(1)
        new = cand.max(1) + unary[:, t]
        live = (t < size)[:, None]
        score = np.where(live, new, score)
    out = np.zeros((b, n), dtype=np.int64)
    lab = score.argmax(1)
    for t in range(n - 1, -1, -1):
        live = t < size
        out[live, t] = lab[live]
        lab = np.where(live & (t > 0), back[np.arange(b), t, lab], lab)
    return out


class Field:
    """The trained field, with the weights of every word it has met (by its kind) added up for the four places."""

    KNOWN = 100_000  # kinds of words kept

    def __init__(self, weights: tuple[np.ndarray, np.ndarray]):
        self.emit, self.move = weights
        self.edge = self._word(_EDGE)
        a = np.concatenate([self.move, np.zeros((1, len(LABELS)))])  # the last row and column: a text's end
        b = np.concatenate([self.move, np.zeros((len(LABELS), 1))], axis=1)
        both = a[:, :, None] + b[None]
        #: The most that another label than O can gain by its transitions.
        self.sway = float((both.max(axis=1) - both[:, 0]).max())
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.sums = np.zeros((1024, 4, len(LABELS)))

    def _word(self, features: tuple[int, ...]) -> np.ndarray:
        f = np.array(features)
        return np.stack([self.emit[f + k * QUARTER].sum(0) for k in range(4)])

    def unary(self, data: np.ndarray, w: T.Words) -> np.ndarray:
        """Weights of the labels of every word of a slice."""
        h, first, inv = np.unique(word_kinds(data, w), return_index=True, return_inverse=True)
        if len(self.place) + len(h) > self.KNOWN:
            self.forget()
        at = np.empty(len(h), dtype=np.int64)
        for i, (x, k) in enumerate(zip(h.tolist(), first.tolist(), strict=True)):
            p = self.place.get(x)
            if p is None:
                p = self.place[x] = len(self.place)
                if p == len(self.sums):
                    self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
                self.sums[p] = self._word(_word_features(data[w.start[k] : w.end[k]].tobytes().decode("utf-8", "replace")))
            at[i] = p
        at = at[inv]
        own = self.sums[at]
        u = own[:, 0].copy()
        doc = w.doc
        for k, shift in ((1, 1), (2, 2), (3, -1)):
            there = np.zeros(len(at), dtype=bool)
            if shift > 0:
                there[shift:] = doc[shift:] == doc[:-shift]
            else:
                there[:shift] = doc[:shift] == doc[-shift:]
            i = np.flatnonzero(there)
            u[i] += own[i - shift, k]
            u[~there] += self.edge[k]
        return u

    def secret_words(self, data: np.ndarray, off: np.ndarray, w: T.Words, width: int = 512) -> np.ndarray:
        """Which words of a slice the best label sequences of its texts call secret."""
        out = np.zeros(len(w.start), dtype=bool)
        if not len(out):
            return out
        u = self.unary(data, w)
        doc = w.doc
        # a word that leads by more than transitions can give is O on the best path, and cuts its text there
        open_ = u[:, 0] - u[:, 1:].max(axis=1) <= self.sway + 1e-9
        i = np.flatnonzero(open_)
        if not len(i):
            return out
        new = np.append(True, (i[1:] != i[:-1] + 1) | (doc[i[1:]] != doc[i[:-1]]))
        lo = i[new]
        size = np.diff(np.append(np.flatnonzero(new), len(i)))
        hi = lo + size
        before = (lo > 0) & (doc[np.maximum(lo - 1, 0)] == doc[lo])
        after = (hi < len(doc)) & (doc[np.minimum(hi, len(doc) - 1)] == doc[lo])
        order = np.argsort(size, kind="stable")
        k = 0
        while k < len(order):
            part = order[k : k + width]
            part = part[: max(1, int((size[part] * np.arange(1, len(part) + 1) <= 200_000).sum()))]  # padded size, as they are ordered
            k += len(part)
            n = int(size[part].max())
            batch_u = np.zeros((len(part), n, len(LABELS)))
            rows = np.repeat(np.arange(len(part)), size[part])
            cols = np.arange(len(rows)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
            batch_u[rows, cols] = u[lo[part][rows] + cols]
            batch_u[before[part], 0] += self.move[0]
            last = np.flatnonzero(after[part])
            batch_u[last, size[part][last] - 1] += self.move[:, 0]
            labels = viterbi(batch_u, size[part], self.move)
            out[lo[part][rows] + cols] = labels[rows, cols] == 2
        return out


def secrets(texts: list[str], field: Field) -> list[list[tuple[int, int]]]:
    """Spans the random field labels as secrets, for each text; surrounding quotes and marks are left out."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    data, off = T.flat(pa.array(texts, pa.large_string()))
    for lo, hi in T.slices(off):
        part, o = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        w = T.find_words(part, o)
        doc = w.doc
        for k in np.flatnonzero(field.secret_words(part, o, w)).tolist():
            word = part[w.start[k] : w.end[k]].tobytes().decode()
            core = word.strip(_STRIP)
            if core:
                before = part[o[doc[k]] : w.start[k]]
                s = int(((before & 0xC0) != 0x80).sum()) + word.find(core)
                found[lo + int(doc[k])].append((s, s + len(core)))
    return found


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_secret", pa.int64()), ("redacted", pa.large_string())])


def merge(base: list[tuple[int, int, int]], extra: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base spans with the added ones that touch none of them; kind 4 is the added kind."""
    return sorted([*base, *((s, 4, e) for s, e in extra if all(e <= a or s >= b for a, _, b in base))])


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Spans replaced by their kind in angle brackets; overlapping spans count as one of the first kind."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{(*KINDS, SECRET)[k]}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def find_personal_data(docs: DataFrame, redacted: bool = False) -> DataFrame:
    """Spans, counts and the base digest of every document; the redacted text too where asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(train())  # FEATURES x labels numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(shared.value)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                texts = [t or "" for t in b.column(1).slice(lo, 256).to_pylist()]
                base = [base_spans(t) for t in texts]
                both = [merge(s, x) for s, x in zip(base, secrets(texts, field), strict=True)]
                line = lambda spans: ",".join(f"{(*KINDS, SECRET)[k]}:{s}:{e}" for s, k, e in spans)
                count = lambda spans, k: sum(x[1] == k for x in spans)
                yield batch(
                    _SCHEMA, doc_id=b.column(0).slice(lo, 256), n_email=[count(s, 0) for s in base], n_ip=[count(s, 1) for s in base], n_card=[count(s, 2) for s in base], n_phone=[count(s, 3) for s in base],
                    base_sha256=[hashlib.sha256(line(s).encode()).hexdigest() for s in base], spans=[line(s) for s in both], n_secret=[count(s, 4) for s in both],
                    redacted=[redact(t, s) for t, s in zip(texts, both, strict=True)] if redacted else [None] * len(texts),
                )

    out = records(docs).mapInArrow(_plain(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, redacted string")
    return out if redacted else out.drop("redacted")


def _plain(run):
    def cast(batches):
        for b in run(batches):
            yield b.set_column(b.num_columns - 1, "redacted", b.column(b.num_columns - 1).cast(pa.string()))

    return cast


def op9_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(documents(spark, sf_dir))
