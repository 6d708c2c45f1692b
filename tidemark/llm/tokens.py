"""Token counts at every prefix of a text.

The counts are stored first and asked then: `step_table` writes, for each text, how the count changes with each
character, a byte a character, and totals, budgets and counts at any place are read from it without encoding.

A text is cut before each single space that stands between two characters other than white space. The tokenizer never
joins bytes over such a cut, so the counts of the pieces add up; the steps of a piece are worked out once for each task.
Within a piece they follow from its pre-tokens, the stretches that the tokenizer splits a text into before it merges:
a dynamic programme over the bytes of one has the count at every prefix. The last token of a prefix is the one token that
ends there and stands beside the last token of what is left as the tokenizer itself would leave them. It takes one pass,
with at most as many steps at a byte as the longest token has bytes, and encodes no prefix.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common as C

#: A space beside white space of any kind: there the cut is not safe, and the text stays whole.
_UNSAFE_ARROW = r"^ |[\t-\r\x1c- ] | [\t-\r\x1c- ]| $|\xc2\x85|\xc2\xa0|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: Encoded pieces that a task remembers.
CACHE = 400_000
#: Pre-tokens of at most so many bytes share what they have found; a change of their counts fits in a byte.
SHORT = 64
#: Prefix counts in a row of a prefix table.
BLOCK = 1 << 16
#: White space of the tokenizer's splitting pattern, and the endings that it keeps whole.
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))
_ENDINGS = ("'re", "'ve", "'ll")
#: Two characters of white space in a row.
_RUN = re.compile("[%s]{2}" % "".join(sorted(_WHITE)))


def _letters() -> list[str]:
    """The characters that byte-level models write for the 256 bytes: printable ones of Latin-1 stand for themselves, the
    rest are numbered from 256 on in order of bytes."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    moved = iter(range(256, 512))
    return [chr(x if x in plain else next(moved)) for x in range(256)]


_LETTERS = _letters()
#: Those of the bytes within a UTF-8 character.
_INNER = frozenset(_LETTERS[0x80:0xC0])
_WITHIN = re.compile(f"[{''.join(_LETTERS[0x80:0xC0])}]")
#: The splitting pattern of byte-level models as it works on ASCII.
_ASCII = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII)


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a list of strings to their token counts, for a .json or .model file."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    encode = getattr(model, "encode_batch_fast", model.encode_batch)
    return lambda texts: [len(x) for x in encode(texts, add_special_tokens=False)]


def can_cut(path: str) -> bool:
    """Whether pieces add up: byte-level models cut before spaces; others are encoded whole."""
    if not path.endswith(".json"):
        return False
    import json

    from tokenizers.pre_tokenizers import ByteLevel

    with open(path) as f:
        model = json.load(f)
    pre, bpe, added = model.get("pre_tokenizer") or {}, model["model"], model.get("added_tokens") or []
    if model.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space"):
        return False
    if bpe.get("type") != "BPE" or any(bpe.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")) or not set(ByteLevel.alphabet()) <= bpe["vocab"].keys():
        return False
    named = [x["content"] for x in added]
    return not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")) and not any(" " in x or any(x is not y and y in x for y in named) for x in named)


def _ranks(path: str) -> tuple[dict[tuple[str, str], int], dict[str, tuple[int, str, str]]] | None:
    """Ranks of the merges, and for each merged token its merge; None if one token has several, or comes before its
    parts, as then the order of ranks is not the order in which a token grows."""
    import json

    with open(path) as f:
        listed = json.load(f)["model"]["merges"]
    pairs, made = {}, {}
    for rank, pair in enumerate(listed):
        a, b = pair.split(" ") if isinstance(pair, str) else pair
        if a + b in made or any(len(x) > 1 and x not in made for x in (a, b)):
            return None
        pairs[a, b], made[a + b] = rank, (rank, a, b)
    return pairs, made


def _packed(counts: list[int]) -> bytes | None:
    """The changes between counts as signed bytes, or None where one does not fit."""
    return _narrow(np.diff(np.array(counts, np.int64)))


class Units:
    """Pre-tokens of a byte-level model, written a character for each byte, and the counts of their prefixes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model, self.split = whole.model, whole.pre_tokenizer.pre_tokenize_str
        self.vocab = frozenset(whole.get_vocab(with_added_tokens=False))
        self.starts = frozenset(x[:k] for x in self.vocab for k in range(1, len(x) + 1))
        named = [x.content for x in whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, named))) if named else None
        #: No token has more bytes.
        self.longest = max(map(len, [*self.vocab, *(x.encode() for x in named)]))
        self.known: dict[str, int] = {}
        self.beside: dict[tuple[str, str], bool] = {}
        self.stepped: dict[str, bytes | None] = {}
        self.shared: dict[str, tuple[int, str, bytes]] = {"": (0, "", b"")}
        self.ranks = _ranks(path)
        self.left: dict[str, list[tuple[str, float]]] = {}
        self.right: dict[str, list[tuple[str, float]]] = {}

    def __call__(self, unit: str) -> int:
        """Tokens of a pre-token."""
        n = self.known.get(unit)
        if n is None:
            if len(self.known) > CACHE:
                self.known.clear()
            n = self.known[unit] = len(self.model.tokenize(unit))
        return n

    def stand(self, a: str, b: str) -> bool:
        """Whether token b stands after token a, or at the start if a is empty, when nothing else is there."""
        found = self.beside.get((a, b))
        if found is None:
            if len(self.beside) > CACHE:
                self.beside.clear()
            if a and self.ranks:
                found = self._unmerged(a, b)
            else:
                found = [x.value for x in self.model.tokenize(a + b)] == ([a, b] if a else [b])
            self.beside[a, b] = found
        return found

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The tokens that a token was at one of its ends while it was merged, each with the rank that ended it."""
        known = (self.left, self.right)[side]
        found = known.get(token)
        if found is None:
            found, rank, part = [], math.inf, token
            while True:
                found.append((part, rank))
                made = self.ranks[1].get(part)
                if made is None:
                    break
                rank, part = made[0], made[1 + side]
            known[token] = found
        return found

    def _unmerged(self, a: str, b: str) -> bool:
        """Whether no merge joins the end of a to the start of b before either has grown past it. Merges go by rank, equal
        ones from the left, so a merge within a goes before one of equal rank over the border, and one within b after it."""
        pairs = self.ranks[0]
        for y, ends in self._edge(b, 0):
            for x, gone in self._edge(a, 1):
                rank = pairs.get((x, y))
                if rank is not None and rank < gone and rank <= ends:
                    return False
        return True

    def steps(self, unit: str) -> bytes | None:
        """The change of the count with each character of a pre-token, a signed byte each; None where one needs more."""
        found = self.stepped.get(unit, b"")
        if found == b"":
            if len(self.stepped) > CACHE:
                self.stepped.clear()
            found = self.stepped[unit] = self.worked(unit)
        return found

    def worked(self, unit: str) -> bytes | None:
        """Steps that are not remembered."""
        if unit in _ENDINGS:
            # Cut short it is no ending: the apostrophe stands by itself.
            return _packed([0, 1, 2, 1])
        found = self._shared(unit) if len(unit) <= SHORT else _packed(self.prefixes(unit))
        if found is None or not _WITHIN.search(unit):
            return found
        # The changes within a character count at its end.
        changes, held = [], 0
        for j, change in enumerate(found, 1):
            held += change - (change >> 7 << 8)
            if j == len(unit) or unit[j] not in _INNER:
                changes.append(held)
                held = 0
        return bytes(x & 255 for x in changes) if all(-128 <= x < 128 for x in changes) else None

    def _shared(self, unit: str) -> bytes:
        """The change of the count with each byte of a short pre-token: what others that start alike have found is kept."""
        known, vocab, stand, longest = self.shared, self.vocab, self.stand, self.longest
        if len(known) > CACHE:
            known.clear()
            known[""] = (0, "", b"")
        n = len(unit)
        done = n
        while unit[:done] not in known:
            done -= 1
        count, _, steps = known[unit[:done]]
        for j in range(done + 1, n + 1):
            for i in range(max(0, j - longest), j):
                token = unit[i:j]
                if token in vocab:
                    before = known[unit[:i]]
                    if stand(before[1], token):
                        break
            steps += (before[0] + 1 - count & 255).to_bytes()
            count = before[0] + 1
            known[unit[:j]] = (count, token, steps)
        return steps

    def prefixes(self, unit: str) -> list[int]:
        """Tokens of the prefixes of a pre-token, of 0, 1, ... bytes."""
        n = len(unit)
        last: list[str | None] = ["", *[None] * n]
        count = [0] * (n + 1)
        starts, vocab, stand = self.starts, self.vocab, self.stand
        for i in range(n):
            before, more = last[i], count[i] + 1
            for j in range(i + 1, n + 1):
                token = unit[i:j]
                if token not in starts:
                    break
                if last[j] is None and token in vocab and stand(before, token):
                    last[j], count[j] = token, more
        return count


@lru_cache(maxsize=2)
def units(path: str) -> Units:
    return Units(path)


class Counter:
    """Counts of pieces, remembered up to CACHE of them."""

    def __init__(self, path: str):
        self.path, self.encode, self.known = path, encoder(path), {}

    def __call__(self, pieces: list[str]) -> np.ndarray:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [x for x in pieces if x not in self.known]
        if new:
            self.known.update(zip(new, self.encode(new)))
        return np.fromiter((self.known[x] for x in pieces), np.int64, len(pieces))


class _Stretch:
    """Token counts at the prefixes of a text without added tokens."""

    def __init__(self, text: str, units: Units):
        found = units.split(text) if text else []
        self.text, self.units, self.found = text, units, [x for x, _ in found]
        self.chars = np.array([0, *(end for _, (_, end) in found)], np.int64)
        self.at = np.concatenate([[0], np.cumsum([units(x) for x in self.found], dtype=np.int64)])
        self.inner: dict[int, np.ndarray] = {}

    def counts(self, i: int) -> np.ndarray:
        """Tokens of the text up to 0, 1, ... characters of pre-token i."""
        if i not in self.inner:
            start, stop = int(self.chars[i]), int(self.chars[i + 1])
            piece = self.text[start:stop]
            n = np.array(self.units.prefixes(self.found[i]), np.int64)[np.cumsum([0, *(len(x.encode()) for x in piece)])]
            if piece in _ENDINGS:
                # Cut short it is no ending: the apostrophe stands by itself.
                n[2] = 2
            n += self.at[i]
            if i and piece[0] in _WHITE and self.text[start - 1] in _WHITE:
                # A run of white space gives its last character away only if more follows.
                n[1] = self.at[i - 1] + self.units(self.units.split(self.text[self.chars[i - 1] : start + 1])[0][0])
            self.inner[i] = n
        return self.inner[i]

    def all(self) -> Iterator[np.ndarray]:
        """The counts at 0, 1, ... characters, in parts; what is done with is forgotten."""
        yield np.zeros(1, np.int64)
        for i in range(len(self.found)):
            yield self.counts(i)[1:]
            self.inner.clear()

    def tokens(self, chars: int) -> int:
        if chars <= 0 or not self.found:
            return 0
        i = min(int(np.searchsorted(self.chars, chars)) - 1, len(self.found) - 1)
        return int(self.counts(i)[min(chars, len(self.text)) - self.chars[i]])

    def fits(self, budget: int) -> int:
        i = int(np.searchsorted(self.at, budget, side="right")) - 1
        if i >= len(self.found):
            return len(self.text)
        if i + 1 < len(self.found) and self.counts(i + 1)[1] <= budget:
            return int(self.chars[i + 1]) + 1
        return int(self.chars[i] + np.flatnonzero(self.counts(i) <= budget)[-1])


class PrefixCounts:
    """Exact token counts at the prefixes of one text."""

    def __init__(self, text: str, count: Counter, cut: bool = True):
        self.text, self.count = text, count
        self.stretches: list[_Stretch] = []
        self.at, self.chars = [0], [0]
        if not cut:
            return
        known = units(count.path)
        for m in known.added.finditer(text) if known.added else ():
            # Until its last character an added token is text like any other.
            self.stretches.append(_Stretch(text[self.chars[-1] : m.end() - 1], known))
            self.at.append(self.at[-1] + self.stretches[-1].tokens(m.start() - self.chars[-1]) + 1)
            self.chars.append(m.end())
        self.stretches.append(_Stretch(text[self.chars[-1] :], known))

    def all(self) -> Iterator[np.ndarray]:
        """The counts at 0, 1, ... characters, in parts."""
        for at, stretch in zip(self.at, self.stretches):
            for part in stretch.all():
                yield part + at

    def tokens(self, chars: int) -> int:
        """Tokens of the first `chars` characters."""
        if not self.stretches:
            return int(self.count([self.text[:chars]])[0])
        i = int(np.searchsorted(self.chars, chars, side="right")) - 1
        return self.at[i] + self.stretches[i].tokens(chars - self.chars[i])

    def fits(self, budget: int) -> int:
        """Characters of the longest prefix of at most `budget` tokens."""
        if not self.stretches:
            return len(self.text) if self.tokens(len(self.text)) <= budget else _search(self.text, self.count, budget)
        i = int(np.searchsorted(self.at, budget, side="right")) - 1
        return self.chars[i] + self.stretches[i].fits(budget - self.at[i])


class _AsciiSteps(dict):
    """Steps of ASCII pre-tokens as they stand in a text, up to CACHE of them."""

    def __init__(self, units: Units):
        self.units = units

    def __missing__(self, unit: str) -> bytes | None:
        if len(self) > CACHE:
            self.clear()
        found = self[unit] = self.units.worked(unit.translate(_LETTERS))
        return found


class Steps:
    """The change of the token count with each character of a text. Pre-tokens of ASCII texts, and pieces of others, are
    worked out once for each task and remembered up to CACHE of them."""

    def __init__(self, path: str):
        self.count, self.units = Counter(path), units(path)
        self.ascii = _AsciiSteps(self.units)
        self.known: dict[str, bytes | None] = {}

    def _ascii(self, text: str) -> bytes | None:
        """Steps of an ASCII text without added tokens."""
        found = _ASCII.findall(text)
        parts = list(map(self.ascii.__getitem__, found))
        if None in parts:
            return None
        steps = b"".join(parts)
        if not _RUN.search(text):
            return steps
        # A run of white space gives its last character away only if more follows: cut behind it, all is one pre-token.
        ends = np.cumsum([len(x) for x in found])
        wide = np.frombuffer(steps, np.int8).astype(np.int64)
        for i, run in enumerate(found[:-1]):
            if run.isspace() and found[i + 1][0].isspace():
                at = int(ends[i])
                more = self._tokens(run + text[at]) - self._tokens(run) - wide[at]
                wide[at] += more
                if at + 1 < len(wide):
                    wide[at + 1] -= more
        return _narrow(wide)

    def _tokens(self, unit: str) -> int:
        return self.units(unit.translate(_LETTERS))

    def _learn(self, pieces: list[str]) -> None:
        """Steps of pieces that are not ASCII."""
        if len(self.known) > CACHE:
            self.known.clear()
        new = [x for x in pieces if x not in self.known]
        plain = [x for x in new if x.startswith(" ") and not _RUN.search(x) and not self._added(x)]
        # Such pieces end where the next one's space is, so all of them are split as one text.
        found, at, end = self.units.split("".join(plain)) if plain else [], 0, 0
        for piece in plain:
            end += len(piece)
            parts = []
            while at < len(found) and found[at][1][1] <= end:
                parts.append(self.units.steps(found[at][0]))
                at += 1
            self.known[piece] = None if None in parts else b"".join(parts)
        for piece in new:
            if piece not in self.known:
                self.known[piece] = _narrow(self.wide(piece))

    def _cut(self, text: str) -> bytes | None:
        """Steps of a text that is cut before its spaces: stretches of ASCII pieces as one, other pieces by themselves."""
        head, *rest = text.split(" ")
        groups = [(ascii, list(x)) for ascii, x in groupby([head, *(" " + x for x in rest)], str.isascii)]
        self._learn(list(dict.fromkeys(x for ascii, group in groups if not ascii for x in group)))
        parts = []
        for ascii, group in groups:
            if ascii:
                stretch = "".join(group)
                parts.append(_narrow(self.wide(stretch)) if self._added(stretch) else self._ascii(stretch))
            else:
                parts.extend(map(self.known.__getitem__, group))
        return None if None in parts else b"".join(parts)

    def _added(self, text: str) -> bool:
        return self.units.added is not None and self.units.added.search(text) is not None

    def wide(self, text: str) -> np.ndarray:
        return np.diff(np.concatenate(list(PrefixCounts(text, self.count).all())))

    def __call__(self, texts: pa.Array) -> Iterator[tuple[bytes, int]]:
        """For each text its steps and the bytes that each takes."""
        safe = ~pc.match_substring_regex(texts.cast(pa.large_binary()), _UNSAFE_ARROW).to_numpy(zero_copy_only=False)
        for ok, text in zip(safe, texts.to_pylist()):
            found = None
            if text.isascii() and not self._added(text):
                found = self._ascii(text)
            elif ok and text:
                found = self._cut(text)
            if found is None:
                steps = self.wide(text)
                found = _narrow(steps)
                if found is None:
                    yield steps.astype("<i8").tobytes(), 8
                    continue
            yield found, 1


@lru_cache(maxsize=2)
def stepper(path: str) -> Steps:
    return Steps(path)


def _narrow(steps: np.ndarray) -> bytes | None:
    """Steps as signed bytes, or None where one does not fit."""
    small = steps.astype(np.int8)
    return small.tobytes() if (small == steps).all() else None


def _decoded(base: int, width: int, steps: bytes) -> np.ndarray:
    """The counts of a row of a step table."""
    return base + np.concatenate([[0], np.cumsum(np.frombuffer(steps, f"<i{width}"), dtype=np.int64)])


def _batch(texts: pa.Array, count: Counter, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text, and characters of a prefix within the limit, for models whose texts are not cut."""
    total, fit = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts.to_pylist()):
        total[i] = count.encode([text])[0]
        fit[i] = len(text) if total[i] <= limit else _search(text, count, limit)
    return total, fit


def _search(text: str, count: Counter, limit: int) -> int:
    """Characters of a prefix of at most `limit` tokens, where the next character takes it over: for models whose texts
    are not cut. Halving finds such a place with a few encodings."""
    low, high = 0, len(text)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if count.encode([text[:mid]])[0] <= limit else (low, mid)
    return low


def step_table(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The token counts of all prefixes, to be stored and asked: rows of the columns `keep`, n_bytes and n_tokens of the whole
    text, block, base, width, steps, least, later.

    A row has the counts of the prefixes of block * BLOCK, block * BLOCK + 1, ... characters, BLOCK of them, fewer in a
    text's last row: base is the first, steps the changes after it, width bytes each. least is the smallest of them, and
    later the smallest in the text's later rows, null in the last; so one row alone tells where a budget ends.

    For byte-level BPE models; another raises an error, as its tokens of a prefix do not follow from shorter ones. A null
    text is empty and has the one count 0. Repeated rows are kept; other columns are ignored; an empty table gives an
    empty one. A long text is many rows, so no row grows with it.
    """
    if not can_cut(model):
        raise ValueError(f"no prefix counts for this kind of model: {model}")
    own = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, own)], F.col(text).alias("text"))
    names = [*own, "n_bytes", "n_tokens", "block", "base", "width", "steps", "least", "later"]
    schema = ", ".join([*(f"{k} {rows.schema[k].dataType.simpleString()}" for k in own), "n_bytes long, n_tokens long, block long, base long, width int, steps binary, least long, later long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stepped = stepper(model)
        for batch in C.slices(batches):
            texts = C.plain(batch.column("text"))
            size = pc.binary_length(texts).to_pylist()
            at, out = [], []
            for i, (steps, width) in enumerate(stepped(texts)):
                counts = _decoded(0, width, steps)
                lows = np.minimum.reduceat(counts, np.arange(0, len(counts), BLOCK))
                after = np.minimum.accumulate(lows[::-1])[::-1].tolist()
                for k, low in enumerate(lows.tolist()):
                    first, stop = k * BLOCK, min((k + 1) * BLOCK, len(counts)) - 1
                    at.append(i)
                    out.append((size[i], int(counts[-1]), k, int(counts[first]), width, steps[first * width : stop * width], low, after[k + 1] if k + 1 < len(lows) else None))
            held = [batch.column(k).take(pa.array(at)) for k in range(len(own))]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*held, *(pa.array(x, t) for x, t in zip(zip(*out), types))], names=names)

    return rows.mapInArrow(run, schema).toDF(*keep, *names[len(own) :])


def budgets(table: DataFrame, limit: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each text of a step table: the columns `keep`, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest
    prefix that the budget `limit` holds, which is 0 or more). Nothing is encoded and nothing shuffled: the row where
    the budget ends is told by itself."""
    own = [f"k{i}" for i in range(len(keep))]
    ends = table.where((F.col("least") <= limit) & (F.col("later").isNull() | (F.col("later") > limit)))
    ends = ends.select(*[F.col(c).alias(k) for c, k in zip(keep, own)], "n_bytes", "n_tokens", "block", "base", "width", "steps")
    names = [*own, "n_bytes", "n_tokens", "over_limit", "fit_chars"]
    schema = ", ".join([*(f"{k} {ends.schema[k].dataType.simpleString()}" for k in own), "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            fit = [block * BLOCK + int(np.flatnonzero(_decoded(base, width, steps) <= limit)[-1]) for block, base, width, steps in zip(*(batch.column(c).to_pylist() for c in ("block", "base", "width", "steps")))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own) + 2], pa.array(n > limit), pa.array(fit, pa.int64())], names=names)

    return ends.mapInArrow(run, schema).toDF(*keep, *names[len(own) :])


def token_counts(docs: DataFrame, model: str, limit: int = 512, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: the columns `keep`, n_bytes, n_tokens, over_limit, fit_chars (characters of the longest
    prefix that the budget `limit` holds).

    For byte-level BPE models all prefix counts are written to the shared folder, and the answers are read from there;
    for others texts are encoded whole. A null text counts as empty: 0 bytes, 0 tokens. Rows are independent, so repeats
    and ties need no rule; an empty table gives an empty result.
    """
    if can_cut(model):
        return budgets(C.settle(step_table(docs, model, text, keep), "prefix-steps"), limit, keep)
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("text"))
    names = [*(f"k{i}" for i in range(len(keep))), "n_bytes", "n_tokens", "over_limit", "fit_chars"]
    schema = ", ".join([*(f"k{i} {rows.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))), "n_bytes long, n_tokens long, over_limit boolean, fit_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(model)
        for batch in C.slices(batches):
            texts = C.plain(batch.column("text"))
            total, fit = _batch(texts, count, limit)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pc.binary_length(texts).cast(pa.int64()), pa.array(total), pa.array(total > limit), pa.array(fit)], names=names)

    return rows.mapInArrow(run, schema).toDF(*keep, *names[len(keep) :])


def prefix_table(docs: DataFrame, model: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A step table with its counts written out: rows doc_id, block, counts, where counts are those of the prefixes of
    block * BLOCK, block * BLOCK + 1, ... characters. `key` should name a row; rows of equal keys are not told apart.
    Otherwise as `step_table`."""
    rows = step_table(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), model).select("doc_id", "block", "base", "width", "steps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Counts take eight times the room of steps, so rows go out one by one.
            for i in range(batch.num_rows):
                key, block, base, width, steps = (c.slice(i, 1) for c in batch.columns)
                counts = _decoded(base[0].as_py(), width[0].as_py(), steps[0].as_py())
                yield pa.RecordBatch.from_arrays([key, block, pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts))], names=["doc_id", "block", "counts"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, block long, counts array<long>")


def tokens_at(table: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of asked (doc_id, chars) with n_tokens, the tokens of that many first characters by a prefix table; null
    where there is no such text or prefix. Nothing is encoded."""
    t, a = table.alias("t"), asked.select("doc_id", F.col("chars").cast("long").alias("chars")).alias("a")
    found = a.join(t, F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.floor(F.col("a.chars") / BLOCK) == F.col("t.block")), "left")
    return found.select("a.doc_id", "a.chars", F.get("t.counts", (F.col("a.chars") % BLOCK).cast("int")).alias("n_tokens"))


def longest_prefix(table: DataFrame, budget: int) -> DataFrame:
    """doc_id and fit_chars, the characters of the longest prefix of at most `budget` tokens, by a prefix table."""
    fits = F.filter(F.transform("counts", lambda n, i: F.when(n <= budget, F.col("block") * BLOCK + i)), lambda x: x.isNotNull())
    return table.groupBy("doc_id").agg(F.max(F.array_max(fits)).alias("fit_chars"))


def op6_token_counts(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Digest of the token counts of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, model or public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")
